"""Main text of web pages by template deduction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.common import stored

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_PARTS = re.compile(r"[^a-z0-9]+")

#: Elements of HTML by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NOISE = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", *RAW}
MAIN = {"article", "main"}
REGIONS = {"html", "body", "div", "section", *MAIN}
NOISE_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "notice", "consent", "gdpr", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "reply", "respond", "share", "social", "related", "newsletter", "subscribe", "popup", "modal", "login", "signup", "search", "widget", "toolbar", "masthead", "disclaimer"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}


#: Elements that are never the template's by their text; a text is the template's on so many pages of a host at least.
WHOLE, TEXT_PAGES = {"html", "body", *MAIN}, 3
_MASK, _VECTOR = (1 << 64) - 1, (1 << 62) - 1
#: A text's hash is a polynomial of its words' hashes, modulo a prime.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


@dataclass
class Event:
    """kind: +1 opens, -1 closes, 0 stands alone or is text. key: name with class and id; a text has none."""

    kind: int
    name: str
    key: str
    noise: bool = False
    text: str = ""


def events(page: str) -> Iterator[Event]:
    """The page's tokens in time linear in its length: no part of it is read again for each tag left open."""
    at, raw, opened, held = 0, "", [], Counter()
    for m in _TOKEN.finditer(page):
        name = (m[2] or "").lower()
        if raw and not (m[1] and name == raw):
            continue
        if m.start() > at and not raw:
            yield Event(0, "", "", text=page[at : m.start()])
        at, raw = m.end(), ""
        if not name:
            continue
        if m[1]:
            while held[name]:
                last, key = opened.pop()
                held[last] -= 1
                if last == name:
                    yield Event(-1, name, "/" + key)
                    break
            continue
        key, noise = name, name in NOISE
        if m[3].strip(" /"):
            a = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTRIBUTE.finditer(m[3])}
            marks = [a[n] for n in ("class", "id") if a.get(n)]
            key = ".".join([name, *[re.sub(r"\d+", "0", x) for x in marks]])
            noise |= any(w in NOISE_WORDS for x in marks for w in _PARTS.split(x.lower())) or a.get("role", "").lower() in NOISE_ROLES or "hidden" in a
        if name in VOID or m[3].endswith("/"):
            yield Event(0, name, key, noise)
            continue
        if name in RAW:
            raw = name
        opened.append((name, key))
        held[name] += 1
        yield Event(1, name, key, noise)
    if at < len(page) and not raw:
        yield Event(0, "", "", text=page[at:])


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _spans(found: list[Event]) -> list[tuple[str, int, int]]:
    """(key, first, last) of the elements that are closed: the places of their two tokens. Any two are nested or apart."""
    stack, spans = [], []
    for i, e in enumerate(found):
        if e.kind > 0:
            stack.append((e.key, i))
        elif e.kind < 0:
            while stack:
                key, at = stack.pop()
                if "/" + key == e.key:
                    spans.append((key, at, i))
                    break
    return spans


def _texts(found: list[Event], counts: Counter) -> Iterator[tuple[str, int, int]]:
    """(key, first, rest) of the blocks with a text whose token occurs once: the text token's key, the place of the
    element, and a hash of the page's other text.

    A text's hash is that of its words in order, from hashes of the page's beginnings, so that nested blocks aren't
    read again for each other.
    """
    heads, powers, rests = [0], [1], [0]
    words: list[int] = [0]
    for e in found:
        if not e.key and e.text.strip():
            for w in e.text.split():
                heads.append((heads[-1] * _BASE + xxhash.xxh64_intdigest(w)) % _PRIME)
                powers.append(powers[-1] * _BASE % _PRIME)
            rests.append(rests[-1] + xxhash.xxh64_intdigest(e.text))
        else:
            rests.append(rests[-1])
        words.append(len(heads) - 1)
    for key, first, last in _spans(found):
        if counts[key] == 1 and found[first].name in BLOCKS - WHOLE and words[first] < words[last]:
            i, j = words[first], words[last]
            own = (heads[j] - heads[i] * powers[j - i]) % _PRIME
            yield f"#{key} {own:x}", first, ((rests[-1] - rests[last] + rests[first]) & _MASK) >> 1


def classes(pages: DataFrame) -> DataFrame:
    """(host, key, class, at): tokens that stand in at least half of a host's pages, and their equivalence class.

    A token's occurrence vector has its count in each page of the host. Vectors are compared by a hash that is
    gathered page by page in any order, so tokens and hosts of any frequency are pre-aggregated before the shuffle.
    at is the token's place in the page of the least hash, which is the same page for all tokens of a class. Text
    tokens, an element's key with its text, begin with #; they stand in TEXT_PAGES pages at least, whose other texts
    aren't all the same (or copies of a page would be templates).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for url, page in zip(b.column(0), b.column(1), strict=True):
                url, page = url.as_py(), page.as_py() or ""
                own, h, found = xxhash.xxh64_hexdigest(f"{url} {page}"), host(url), list(events(page))
                counts = Counter(e.key for e in found if e.key)
                places: dict[str, int] = {"": 0}
                for at, e in enumerate(found):
                    places.setdefault(e.key, at)
                rests = {key: (at, rest) for key, at, rest in _texts(found, counts)}
                counts[""] = 1
                page_hash = int(own, 16) >> 1
                for key, n in [*counts.items(), *((key, 1) for key in rests)]:
                    at, rest = rests.get(key) or (places[key], 0)
                    x = seen.setdefault((h, key), [0, 0, page_hash, at, rest, rest])
                    x[0] = (x[0] + (xxhash.xxh64_intdigest(f"{own} {n}") >> 24)) & _VECTOR
                    x[1] += 1
                    x[2], x[3] = min((x[2], x[3]), (page_hash, at))
                    x[4], x[5] = min(x[4], rest), max(x[5], rest)
            keys = list(seen)
            columns = [pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(6)]
            names = ["host", "key", "vector", "n", "page", "at", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *columns], names)

    found = pages.select("url", "html").mapInArrow(run, "host string, key string, vector long, n long, page long, at long, low long, high long")
    found = found.groupBy("host", "key").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("class"), F.sum("n").alias("n"), F.min(F.struct("page", "at")).alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = stored(found.select("host", "key", "class", "n", "first.at", (F.col("low") < F.col("high")).alias("apart")), "tokens")
    all_ = found.where("key = ''").select("host", F.col("n").alias("pages"))
    often = found.where("key <> ''").join(all_, "host").where("2 * n >= pages")
    return often.where((F.left("key", F.lit(1)) != "#") | F.col("apart") & (F.col("n") >= TEXT_PAGES)).select("host", "key", "class", "at")


def templates(pages: DataFrame) -> DataFrame:
    """(host, classes, texts): a host's equivalence classes as arrays of tokens in their order, and its text tokens.

    A token of a template stands in half of the pages or more, so a host has at most twice as many as a page of its
    own has on average.
    """
    found = stored(classes(pages), "classes")
    text = F.left("key", F.lit(1)) == "#"
    grouped = found.where(~text).groupBy("host", "class").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("keys"))
    grouped = grouped.groupBy("host").agg(F.sort_array(F.collect_list("keys.key")).alias("classes"))
    texts = found.where(text).groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("texts"))
    return grouped.join(texts, "host", "left")


def _frame(found: list[Event], template: list[list[str]]) -> dict[int, int]:
    """The blocks that hold the slots apart: the place of the opening token of each, and of its closing one.

    Their tokens are of classes that are valid in the page: all tokens of the class occur, once, and in its order.
    Tokens that aren't paired in the page are left out, so that any two blocks are nested or apart.
    """
    counts = Counter(e.key for e in found if e.key)
    places = {e.key: i for i, e in enumerate(found) if e.key}
    valid: set[str] = set()
    for keys in template:
        if all(counts[k] == 1 for k in keys):
            at = [places[k] for k in keys]
            if at == sorted(at):
                valid.update(keys)
    return {first: last for key, first, last in _spans(found) if found[first].name in BLOCKS and key in valid and "/" + key in valid}


def text_of(page: str | None, template: list[list[str]] | None, texts: list[str] | None = None) -> str:
    """The blocks of the slots that hold the page's main text.

    Each block of the frame is a slot, which has the text that lies in it and in no other slot inside it. A slot whose
    text token is the template's, too, goes with all that is in it (unless nothing is left). Of the remaining slots,
    those inside article or main elements are the main text. In a page without one, it is all that lies in the smallest
    slot that encloses the main ones, which have more text outside links than in them, whatever its length. Noise
    elements are left out at any depth.
    """
    found = list(events(page or ""))
    frame = _frame(found, template or [])
    known = set(texts or [])
    fixed = {at for key, at, _ in _texts(found, Counter(e.key for e in found if e.key)) if key in known and at in frame} if known else set()
    stack: list[tuple[str, bool]] = []
    slots: list[tuple[int, str, bool]] = [(0, "", False)]  # parent, element, whether it is the template's
    opened, blocks, buffer = [(0, -1)], [], []
    links: Counter = Counter()
    inside = Counter()  # how many open elements are main, links, or noise

    def push(name: str, noise: bool) -> None:
        stack.append((name, noise))
        inside.update({"main": name in MAIN, "a": name == "a", "noise": noise})

    def pop() -> str:
        name, noise = stack.pop()
        inside.subtract({"main": name in MAIN, "a": name == "a", "noise": noise})
        return name

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            blocks.append((opened[-1][0], inside["main"] > 0, text))

    for at, e in enumerate(found):
        if not e.key:
            if not inside["noise"]:
                text = entities.unescape(e.text)
                buffer.append(text)
                if inside["a"]:
                    links[opened[-1][0]] += len(text)
            continue
        if e.name == "br":
            buffer.append(" ")
        if e.name in BLOCKS:
            flush()
        if e.kind > 0:
            if e.name in MAIN:  # an element left open before doesn't swallow it
                while stack and stack[-1][1]:
                    pop()
            push(e.name, e.noise or e.name == "header" and not inside["main"])
        elif e.kind < 0:
            while stack and pop() != e.name:
                pass
        if at in frame:
            slots.append((opened[-1][0], e.name, slots[opened[-1][0]][2] or at in fixed))
            opened.append((len(slots) - 1, frame[at]))
        elif at == opened[-1][1]:
            opened.pop()
    flush()
    blocks = [b for b in blocks if not slots[b[0]][2]] or blocks
    if any(main for _, main, _ in blocks):
        return "\n".join(t for _, main, t in blocks if main)
    mass: Counter = Counter()
    for s, _, t in blocks:
        mass[s] += len(t)
    main_slots = [s for s, n in mass.items() if n > 2 * links[s]]
    region = _region(main_slots, slots)
    within = [False] * len(slots)
    for i, (parent, *_) in enumerate(slots):  # a slot's parent comes before it
        within[i] = i == region or i > 0 and within[parent]
    return "\n".join(t for s, _, t in blocks if within[s])


def _region(main_slots: list[int], slots: list[tuple[int, str, bool]]) -> int:
    """The smallest slot of a kind that holds blocks and encloses all of main_slots; the page if there are none."""
    if not main_slots:
        return 0
    held = [0] * len(slots)
    for s in main_slots:
        held[s] = 1
    for i in range(len(slots) - 1, -1, -1):
        if held[i] == len(main_slots) and slots[i][1] in REGIONS:
            return i
        if i:
            held[slots[i][0]] += held[i]
    return 0


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): one row per row of pages.

    Null and empty html gives the empty text; a null url counts as a host of its own. Character references are
    decoded, white space inside a block becomes one space, blocks follow each other at \\n. Repeated rows give repeated
    rows, and count again in their host's occurrence vectors; an empty table gives none. Pages are read whole in time
    linear in their length, tags left open included; other columns of pages, of any name, are left alone. Templates are joined by host; their table is small enough to be broadcast where
    Spark finds it so by its size, else a hot host's rows are split by adaptive execution.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(x.as_py(), t.as_py(), k.as_py()) for x, t, k in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    known = stored(templates(pages), "templates")
    h = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = pages.select("page_id", "url", "html").withColumn("host", h).join(known, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "classes", "texts").mapInArrow(run, f"page_id {kind}, url string, text string")
