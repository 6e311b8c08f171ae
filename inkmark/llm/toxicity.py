"""Toxicity by a weighted finite-state grammar over clauses, with weights learned from labels."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the closed classes that the grammar's transducers read, in the four languages of the grammar.
TARGETS = {
    "you", "your", "yours", "yourself", "u", "ur", "he", "she", "him", "her", "they", "them", "these", "those", "people",
    "tu", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "il", "elle", "ils", "elles", "eux", "leur",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "er", "sie", "ihn", "ihnen",
    "usted", "ustedes", "tus", "te", "ti", "él", "ella", "ellos", "ellas", "vosotros",
}
NEGATIONS = {
    "not", "no", "never", "nobody", "none", "neither", "nor", "without", "hardly", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "can't", "cannot",
    "ne", "pas", "jamais", "aucun", "aucune", "sans", "ni", "nicht", "kein", "keine", "keinen", "nie", "niemals", "niemand", "ohne", "weder",
    "nunca", "jamás", "ningún", "ninguna", "nadie", "sin", "tampoco",
}
REPORTS = {
    "said", "says", "say", "saying", "wrote", "writes", "written", "called", "calls", "quoted", "quote", "quotes", "claimed", "claims", "reported", "reports", "told", "tells", "stated", "alleged", "accused",
    "dit", "disait", "écrit", "écrivait", "appelé", "cité", "prétend", "déclaré", "sagte", "sagt", "schrieb", "schreibt", "nannte", "zitierte", "behauptete", "berichtete",
    "dijo", "dice", "escribió", "llamó", "citó", "afirmó", "declaró",
}
THREATS = {
    "kill", "kills", "killed", "hurt", "destroy", "beat", "burn", "punish", "crush", "shoot", "stab", "strangle", "murder",
    "tuer", "tuerai", "frapper", "brûler", "détruire", "töten", "töte", "umbringen", "verprügeln", "vernichten", "matar", "mataré", "golpear", "quemar", "destruir",
}

#: The bound of what is fitted: labelled rows. Prefix lengths, least z-score of a pattern of the lexicon.
TRAIN_ROWS, PREFIXES, LEAST_Z = 30_000, (4, 5, 6, 7), 5.0

_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_JAVA_TOKENS = "[\\p{L}\\p{Nl}\\p{No}]+(?:'[\\p{L}\\p{Nl}\\p{No}]+)?"  # the same in Spark's expressions
_CLAUSES = re.compile(r"[.!?;:\n]+")
_CLOSED = {w: s for s, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in words}
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
#: What the grammar tells apart: each has an arc weight of its own, which is learned.
CONTEXTS = ("plain", "targeted", "negated", "reported")
MATCHES = [(kind, context) for kind in ("insult", "threat") for context in CONTEXTS]


@dataclass
class Transducer:
    """Deterministic and weighted: (state, symbol) -> (state, factor). A missing arc stays, with factor 1."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state: object, symbol: str) -> tuple[object, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(*parts: Transducer) -> Transducer:
    """All read the same symbols side by side; factors multiply. States that can be reached are built, no others."""
    start = tuple(p.start for p in parts)
    whole, todo, seen = Transducer(start), [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            steps = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            to = tuple(s for s, _ in steps)
            whole.arcs[state, symbol] = (to, math.prod(f for _, f in steps))
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return whole


PARTS = ("target", "negation", "report")


def grammar(parts: tuple[str, ...] = PARTS) -> Transducer:
    """Insults and threats score; a target named before strengthens, negation and reported speech weaken.

    The factors are where learning begins. States are (scoring, target, negation, report); parts that are left out
    read everything and change nothing.
    """
    scoring = Transducer(0, {(0, s): (0, 1.0 if s in ("insult", "threat") else 0.0) for s in SYMBOLS})
    target = Transducer(False, {(False, "target"): (True, 1.0), (True, "insult"): (True, 1.25), (True, "threat"): (True, 1.5)})
    negation = Transducer(0)
    for left in range(4):  # reaches over three words
        for s in SYMBOLS:
            negation.arcs[left, s] = (3, 1.0) if s == "negation" else (max(0, left - 1), 0.4 if left and s in ("insult", "threat") else 1.0)
    report = Transducer(False, {(False, "report"): (True, 1.0), (True, "insult"): (True, 0.6), (True, "threat"): (True, 0.6)})
    chosen = {"target": (target, Transducer(False)), "negation": (negation, Transducer(0)), "report": (report, Transducer(False))}
    return compose(scoring, *(chosen[p][p not in parts] for p in PARTS))


def context(state: tuple) -> str:
    """What a match in this state of the grammar is: of several the one that weakens most."""
    return "negated" if state[2] else "reported" if state[3] else "targeted" if state[1] else "plain"


@dataclass
class Model:
    """words and prefixes: the insult lexicon. weights: of 1, of all that the grammar gives for the document, of its
    best clause, and of each of MATCHES; empty if nothing could be learned."""

    words: dict[str, float]
    prefixes: dict[str, float]
    weights: list[float]

    def weight(self, word: str) -> float:
        found = [self.words.get(word, 0.0)]
        found += [self.prefixes.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n]
        return max(found)


class Scorer:
    """A document's features. Words met are remembered, up to a bound."""

    def __init__(self, model: Model, remembered: int = 200_000, machine: Transducer | None = None):
        self.model, self.known, self.remembered, self.machine = model, {}, remembered, machine or grammar()

    def hit(self, word: str) -> float:
        if len(self.known) >= self.remembered:
            self.known = {}
        self.known[word] = w = 2.0 if word in THREATS else self.model.weight(word)
        return w

    def clauses(self, text: str | None) -> Iterator[list[tuple[str, str, float, float]]]:
        """The matches of each matched clause: kind, context, the word's weight, and the factor of the path so far."""
        low = (text or "").lower()
        get, hit, step = self.known.get, self.hit, self.machine.arcs
        hits = {w for w in _TOKENS.findall(low) if (x if (x := get(w)) is not None else hit(w))}
        if not hits:
            return
        for clause in _CLAUSES.split(low):
            tokens = _TOKENS.findall(clause)
            if hits.isdisjoint(tokens):
                continue
            state, found = self.machine.start, []
            for w in tokens:
                symbol = _CLOSED.get(w) or ("insult" if w in hits else "other")
                to, factor = step[state, symbol]
                if factor:
                    found.append((symbol, context(state), get(w) or hit(w), factor))
                state = to
            if found:
                yield found

    def features(self, text: str | None) -> list[float]:
        """1, and logarithms of the clauses' sum and of the best one, by the grammar's factors, and of each of MATCHES."""
        total, best, by = 0.0, 0.0, dict.fromkeys(MATCHES, 0.0)
        for found in self.clauses(text):
            own = sum(w * factor for *_, w, factor in found)
            total, best = total + own, max(best, own)
            for kind, where, w, _ in found:
                by[kind, where] += w
        return [1.0, math.log1p(total), math.log1p(best), *(math.log1p(x) for x in by.values())]

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.model.weights, self.features(text)))))))


def _lexicon(rows: list, counts: Callable, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of the patterns that stand in toxic documents far more often than by chance."""
    share, chosen = toxic / max(1, toxic + clean), []
    for r in rows:
        t, c = counts(r)
        n = t + c
        z = (t - n * share) / math.sqrt(max(1e-9, n * share * (1 - share)))
        w = math.log((t + 1) / (toxic + 2)) - math.log((c + 1) / (clean + 2))
        if t >= 3 and z >= LEAST_Z and w >= 2:
            chosen.append((w, r.pattern))
    return {p[2:]: w for w, p in chosen if p[0] == "w"}, {p[2:]: w for w, p in chosen if p[0] == "p"}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> list[float]:
    """Weights of the arcs, as deviations from the grammar's own factors: those move at a higher price."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, ridge / 5, ridge / 5, *[ridge] * (x.shape[1] - 3)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(id_col) -> F.Column:
    """The rows whose labels are for measuring only: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most about `rows` labelled rows that aren't held out, chosen by the hash of their id.

    The sample's ids are broadcast (bounded by `rows`), so texts aren't shuffled. What documents contain is counted
    in Spark; the bounded counts and features of the sample come to the driver. Features of a sample's row are taken
    with the lexicon of the other half, so that rare patterns aren't trusted for having been learned. A document with
    several labels is toxic if one of them says so; rows that share an id each count. Null texts count as empty, very
    long ones whole; other columns of docs, of any name, are left alone. Without labelled rows of both kinds, as in
    empty tables, nothing is learned.
    """
    own = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id is not null and __toxic is not null")
    own = own.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    own = own.where(~held_out(F.col("__id")))
    share = min(1.0, rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    sample = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "__id")
    sample = sample.withColumn("half", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)))  # equal texts in one half
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_JAVA_TOKENS), F.lit(0)))
    patterns = [F.concat(F.lit("w "), F.col("w")), *[F.when(F.length("w") >= n, F.concat(F.lit("p "), F.left("w", F.lit(n)))) for n in PREFIXES]]
    each = sample.select("half", "__toxic", F.explode(words).alias("w")).select("half", "__toxic", F.explode(F.array(*patterns)).alias("pattern"))
    n = {(h, t): F.sum(F.when((F.col("half") == h) & (F.col("__toxic") == t), 1).otherwise(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)}
    total = sample.agg(*n.values()).first()
    total = {k: total[f"n{k[0]}{k[1]}"] or 0 for k in n}
    found = each.where("pattern is not null").groupBy("pattern").agg(*n.values())
    tox, all_ = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10") + F.col("n01") + F.col("n11")
    t1, t0 = total[0, 1] + total[1, 1], total[0, 0] + total[1, 0]
    if not t1 or not t0:
        return Model({}, {}, [])
    rate = t1 / (t1 + t0)
    found = found.where((tox >= 3) & ((tox - all_ * rate) / F.sqrt(all_ * rate * (1 - rate)) >= LEAST_Z * 0.7)).collect()  # bounded by the sample
    whole = _lexicon(found, lambda r: (r.n01 + r.n11, r.n00 + r.n10), t1, t0)
    halves = [_lexicon(found, lambda r, h=h: (r[f"n{h}1"], r[f"n{h}0"]), total[h, 1], total[h, 0]) for h in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Scorer(Model(*halves[1 - h], [])) for h in (0, 1)]
        for b in batches:
            x = [by[h.as_py()].features(t.as_py()) for t, h in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(2)], ["x", "y"])

    seen = sample.select("text", F.col("half").cast("int"), F.col("__toxic").alias("y")).mapInArrow(run, "x array<double>, y int").collect()
    return Model(*whole, _logistic(np.array([r.x for r in seen]), np.array([r.y for r in seen], float)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the likelihood, 0 to 1, that a document is toxic; one row per row of docs, no shuffle.

    Null and empty texts score as texts without a match. Null ids stay, repeated rows give repeated rows, an empty
    table gives none. A model that had no labelled rows of both kinds scores 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.score(t.as_py()) for t in b.column(1)], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score the threshold or more, with all their columns, whatever their names.

    Null and empty texts score as texts without a match; very long texts are read whole. Null ids and repeated rows
    are judged by their texts alone; an empty table gives none.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([s.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
