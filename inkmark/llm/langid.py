"""Language of texts and of spans within them: scripts narrow the languages down, then Viterbi over per-word scores.

A word's score in a language is its likelihood under a model of three code points at a time. Staying in a language is
free and a switch costs a penalty, so a few odd words don't break a span and a passage in another language does.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First and last code points of blocks of letters, by script. Others are of the script "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "ethiopic": ((0x1200, 0x139F),),
    "khmer": ((0x1780, 0x17FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}

#: Bounds of what is fitted: labelled rows of a language at most, sequences of each length at most. A language uses a
#: script that has this share of its letters. Cost of a switch, of a word outside a language's scripts, most that
#: a word says against a language, weight of the shorter sequence's estimate, code points that are scored at once.
LANGUAGE_ROWS, GRAMS, SCRIPT_SHARE, SWITCH, OUTSIDE, WORD, BACK_OFF, AT_ONCE = 4_000, 300_000, 0.005, 14.0, 12.0, 10.0, 4.0, 2_000_000
UNKNOWN = "und"
_WORDS = "\\p{L}[\\p{L}\\p{M}]*"
_WIDE = 0x110000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks; lower case where that is one code point; the script's number."""
    kind, lower, script = np.zeros(_WIDE, np.uint8), np.arange(_WIDE, dtype=np.int32), np.zeros(_WIDE, np.uint8)
    for c in range(_WIDE):
        name = unicodedata.category(chr(c))[0]
        if name in "LM":
            kind[c] = 2 if name == "L" else 1
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for i, blocks in enumerate(SCRIPTS.values(), 1):
        for first, last in blocks:
            script[first : last + 1] = i
    return kind, lower, script


@dataclass
class Words:
    """The words of some texts: first code point and length of each within its text, its text's number, its letters as
    numbers, lower case, and where its letters begin among all."""

    text: np.ndarray
    at: np.ndarray
    length: np.ndarray
    letters: np.ndarray
    begin: np.ndarray


def words(texts: list[str]) -> Words:
    """A word is a letter and the letters and marks that follow it."""
    kind, lower, _ = _tables()
    # a blank after each text keeps words apart
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.int32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    k = kind[points]
    inside = k > 0
    before = np.concatenate([[False], inside[:-1]])
    # a run of marks without a letter before it isn't a word
    leads = np.maximum.accumulate(np.where(~inside, np.arange(len(k)), -1)) if len(k) else np.zeros(0, int)
    lettered = np.maximum.accumulate(np.where(k == 2, np.arange(len(k)), -1)) if len(k) else leads
    own = inside & (lettered > leads)
    begin = np.flatnonzero(own & ~(before & np.concatenate([[False], own[:-1]])))
    chosen = points[own]
    length = np.diff(np.concatenate([np.searchsorted(np.flatnonzero(own), begin), [len(chosen)]])) if len(begin) else np.zeros(0, int)
    text = np.searchsorted(starts, begin, "right") - 1
    return Words(text, begin - starts[text], length, lower[chosen].astype(np.int64), np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(begin) else np.zeros(0, np.int64))


@dataclass
class Model:
    """languages in order; keys of sequences of one to three code points, sorted, with the log-likelihood of the last
    one after the others by language; the languages that use each script; log-shares of the languages' rows."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)
    uses: np.ndarray | None = None
    prior: np.ndarray | None = None

    def word_scores(self, w: Words) -> np.ndarray:
        """(words, languages). What no language has seen scores alike in all: by its two last code points, or one."""
        n = len(w.length)
        if not n:
            return np.zeros((0, len(self.languages)))
        c = w.letters
        first = np.zeros(len(c), bool)
        first[w.begin] = True
        second = np.concatenate([[False], first[:-1]]) & ~first
        a1 = np.where(first, 0x20, np.concatenate([[0], c[:-1]]))
        a2 = np.where(first | second, 0x20, np.concatenate([[0, 0], c[:-2]])[: len(c)])
        found = np.zeros((len(c), len(self.languages)))
        todo = np.arange(len(c))
        for keys, scores, key in zip(reversed(self.keys), reversed(self.scores), ((a2 << 42) | (a1 << 21) | c, (a1 << 21) | c, c), strict=True):
            if len(keys) and len(todo):
                at = np.minimum(np.searchsorted(keys, key[todo]), len(keys) - 1)
                hit = keys[at] == key[todo]
                found[todo[hit]] = scores[at[hit]]
                todo = todo[~hit]
        out = np.add.reduceat(found, w.begin)
        script = _tables()[2][c[w.begin]]
        allowed = self.uses[script]
        allowed = allowed | ~allowed.any(1, keepdims=True)
        best = np.where(allowed, out, -np.inf).max(1, keepdims=True)
        return np.clip(out, best - WORD, best) - np.where(allowed, 0.0, OUTSIDE)


def viterbi(scores: np.ndarray, text: np.ndarray, texts: int, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of its text. scores(words, languages), the words of a text together.

    Texts go side by side, the longest first, so a step is one operation over all that still have words.
    """
    count = np.bincount(text, minlength=texts)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    count, start = count[order], start[order]
    steps, states = int(count[0]) if texts else 0, np.zeros(len(scores), np.uint8)
    moved, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.uint8)
    v = np.zeros((texts, scores.shape[1]))
    active = np.searchsorted(-count, -np.arange(1, steps + 1), "right")  # texts with more words than the step's number
    for t in range(steps):
        n, at = active[t], start[: active[t]] + t
        if t == 0:
            v[:n] = scores[at] + prior
            continue
        top = v[:n].argmax(1)
        jump = v[np.arange(n), top][:, None] - switch
        moved[at], best[at] = v[:n] < jump, top
        v[:n] = scores[at] + np.maximum(v[:n], jump)
    state = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        n, at = active[t], start[: active[t]] + t
        states[at] = state[:n]
        state[:n] = np.where(moved[at, state[:n]], best[at], state[:n])
    return states


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """(number, offset, part) of the texts in groups of up to AT_ONCE code points; a longer text is cut between words."""
    kind, group, size = _tables()[0], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            if size >= AT_ONCE:
                yield group
                group, size = [], 0
            end = min(len(text), at + AT_ONCE - size)
            cut = end
            while end < len(text) and cut > at and kind[ord(text[cut - 1])]:
                cut -= 1
            if cut == at and size:  # no room for the word: it goes to the next group
                size = AT_ONCE
                continue
            end = cut if cut > at else end  # a word longer than a group is cut
            group.append((i, at, text[at:end]))
            size, at = size + end - at, end
    if group:
        yield group


def label(model: Model, texts: list[str], spans: bool = False) -> list[tuple]:
    """(language, score, spans) of each text; spans(lang, start, length) in code points, if asked for.

    The language is that of most letters on the best path, of equally many the one before in order. The score is their
    share, times the likelihood of that language against the others on the words labelled with it.
    """
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(model.languages)), np.float32))]
    for group in _pieces(texts):
        w = words([p for _, _, p in group])
        number, offset = np.array([i for i, _, _ in group]), np.array([o for _, o, _ in group])
        parts.append((number[w.text], w.at + offset[w.text], w.length, model.word_scores(w).astype(np.float32)))
    text, at, length, scores = (np.concatenate(v) for v in zip(*parts, strict=True))
    n, k = len(texts), len(model.languages)
    states = viterbi(scores, text, n, model.prior)
    letters = np.bincount(text * k + states, length, n * k).reshape(n, k)
    lang = letters.argmax(1)
    mine = states == lang[text]
    total = np.stack([np.bincount(text[mine], scores[mine, j], n) for j in range(k)], 1) + model.prior
    total -= total.max(1, keepdims=True)
    sure = np.exp(total[np.arange(n), lang]) / np.exp(total).sum(1)
    all_ = letters.sum(1)
    share = np.divide(letters.max(1), all_, out=np.zeros(n), where=all_ > 0) * sure
    found = [[] for _ in texts]
    if spans and len(states):
        new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(states.astype(int)) != 0)])
        begin = np.flatnonzero(new)
        last = np.concatenate([begin[1:], [len(states)]]) - 1
        for i, j in zip(begin, last, strict=True):
            found[text[i]].append((model.languages[states[i]], int(at[i]), int(at[j] + length[j] - at[i])))
    return [(model.languages[lang[i]], float(share[i]), found[i]) if all_[i] else (UNKNOWN, 0.0, []) for i in range(n)]


def held_out(id_col) -> F.Column:
    """The rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def _grams(counted: DataFrame, n: int) -> DataFrame:
    """(lang, gram, n) of counted words(lang, w, n): a word with two blanks before it; at most GRAMS, the commonest."""
    padded = F.concat(F.lit("  "), F.col("w"))
    at = F.sequence(F.lit(3), F.length(padded))
    each = counted.select("lang", "n", F.explode(F.transform(at, lambda i: F.substr(padded, i - (n - 1), F.lit(n)))).alias("gram"))
    return each.groupBy("gram", "lang").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "gram").limit(GRAMS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LANGUAGE_ROWS) -> Model | None:
    """Learns from at most about `rows` rows of each language, chosen by a hash of id and text, that aren't held out
    and have a language, an id and a text; None if there are none.

    Words and sequences are counted in Spark. What comes to the driver is a row a language, and counts of at most
    GRAMS sequences of each of three lengths. Repeated rows count as often; other columns are left alone.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(F.col("id")), F.lit(False)))
    there = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return None
    languages = sorted(there)
    part = F.element_at(F.create_map(*[F.lit(x) for l in languages for x in (l, min(1_000_000, 1_000_000 * rows // there[l]))]), F.col("lang"))
    chosen = own.where(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1_000_000)) < part)
    counted = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counted = counted.persist()
    found = [_grams(counted, n).collect() for n in (1, 2, 3)]
    counted.unpersist()
    counts = []
    for at, row_set in enumerate(found):
        key = [sum(ord(ch) << (21 * (at - i)) for i, ch in enumerate(r.gram)) for r in row_set]
        table = np.array([[r.by.get(l, 0) for l in languages] for r in row_set], float).reshape(-1, len(languages))
        order = np.argsort(np.array(key, np.int64))
        counts.append((np.array(key, np.int64)[order], table[order]))
    return _model(languages, counts, np.array([there[l] for l in languages], float))


def _model(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> Model:
    """Likelihoods from counts of one, two and three code points, each smoothed towards the shorter one's."""
    model = Model(languages, prior=np.log(rows / rows.sum()) * 0.5)
    (one, n1), (two, n2), (three, n3) = counts
    total = n1.sum(0)
    p1 = (n1 + 0.5) / (total + 0.5 * (len(one) + 1))

    def after(key: np.ndarray, n: np.ndarray, shorter: np.ndarray, p: np.ndarray) -> np.ndarray:
        context, inverse = np.unique(key >> 21, return_inverse=True)
        sums = np.zeros((len(context), n.shape[1]))
        np.add.at(sums, inverse, n)
        mask = (1 << 21) - 1 if n is n2 else (1 << 42) - 1
        at = np.minimum(np.searchsorted(shorter, key & mask), len(shorter) - 1)
        base = np.where((shorter[at] == key & mask)[:, None], p[at], p.min(0))
        return (n + BACK_OFF * base) / (sums[inverse] + BACK_OFF)

    p2 = after(two, n2, one, p1) if len(two) else n2
    p3 = after(three, n3, two, p2) if len(three) else n3
    model.keys, model.scores = [one, two, three], [np.log(p) for p in (p1, p2, p3)]
    script = _tables()[2][one] if len(one) else np.zeros(0, int)
    share = np.zeros((len(SCRIPTS) + 1, len(languages)))
    np.add.at(share, script, n1)
    model.uses = share >= SCRIPT_SHARE * np.maximum(total, 1)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, lang_pred, score), and spans array<struct<lang, start, length>> in code points if asked for: a row a row.

    A null text, an empty one, one without letters, and every text without a model is `und`, with score 0 and no
    spans. Texts are read whole, however long; null ids and repeated rows stay; an empty table gives none. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, todo, size = [t or "" for t in b.column(1).to_pylist()], [], [], 0
            for t in texts:  # so many code points at once, or one text
                if todo and size + len(t) > AT_ONCE:
                    found, todo, size = found + label(model, todo, spans), [], 0
                todo.append(t)
                size += len(t)
            found += label(model, todo, spans) if todo else []
            yield made(b.column(0), found)

    def made(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        columns = [ids, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        more = [pa.array([[dict(zip(("lang", "start", "length"), s, strict=True)) for s in f[2]] for f in found], kind)] if spans else []
        return pa.RecordBatch.from_arrays([*columns, *more], ["id", "lang_pred", "score", "spans"][: 3 + spans])

    def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield made(b.column(0), [(UNKNOWN, 0.0, [])] * b.num_rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<lang: string, start: int, length: int>>" * spans
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run if model else none, schema)
