"""SimHash near-duplicates with bit-sliced comparison of fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.llm.common import stored
from inkmark.llm.components import connected

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the shingles of `width` words, repeats included; 0 where there is no word."""
    words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    spans = zip(starts, (x - 1 for x in starts[width:]), strict=False) if len(words) >= width else [(0, len(joined))]
    digest, n, counts, block = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64), []
    for a, b in spans:
        block.append(digest(joined[a:b], seed))
        if len(block) == 1 << 15:
            counts, n, block = counts + _set_bits(block), n + len(block), []
    if block:
        counts, n = counts + _set_bits(block), n + len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _set_bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long. Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def near(fps: np.ndarray, radius: int = 3, tile: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each tile of fingerprints (first row, bool[rows, all]): which others differ in `radius` bits at most (<= 3).

    The fingerprints' bits stand as 64 planes, one lane a fingerprint. A plane's difference goes into all lanes'
    distances at once, by carry-save addition: two bits count to three, a third keeps what went beyond. A tile is
    abandoned as soon as every lane is beyond.
    """
    m, lanes = len(fps), -(-len(fps) // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((lanes * 64, 64), np.uint8)
    padded[:m] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view("<u8")
    unused = np.packbits(np.arange(lanes * 64) >= m, bitorder="little").view("<u8")
    masks = np.where(bits.astype(bool), _ALL, np.uint64(0))
    for at in range(0, m, tile):
        own = masks[at : at + tile]
        ones, twos = np.zeros((len(own), lanes), np.uint64), np.zeros((len(own), lanes), np.uint64)
        beyond = np.repeat(unused[None, :], len(own), 0)
        for b in range(64):
            x = planes[b][None, :] ^ own[:, b][:, None]
            carry = ones & x
            ones ^= x
            beyond |= twos & carry
            twos ^= carry
            if radius < 3 and b == 63:
                beyond |= twos if radius < 2 else twos & ones
                beyond |= ones if radius < 1 else np.uint64(0)
            if b % 8 == 7 and (beyond == _ALL).all():
                break
        yield at, ~np.unpackbits(beyond.view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool)


def forest(fps: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together all fingerprints of a block that are linked in it: under one a fingerprint."""
    linked = np.concatenate([x for _, x in near(fps, radius)])
    np.fill_diagonal(linked, False)
    open_, us, vs = np.ones(len(fps), bool), [], []
    for root in np.flatnonzero(linked.any(1)):
        if not open_[root]:
            continue
        open_[root], todo = False, [root]
        while todo:
            u = todo.pop()
            found = np.flatnonzero(linked[u] & open_)
            open_[found] = False
            us.append(np.full(len(found), u))
            vs.append(found)
            todo.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return fps[np.concatenate(us) if us else none], fps[np.concatenate(vs) if vs else none]


def _keys(fp: Column, radius: int) -> Column:
    """Of radius + 2 blocks of the bits at least two are equal: one key for each pair of blocks."""
    cuts = np.linspace(0, 64, radius + 3).astype(int).tolist()
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = combinations(range(len(blocks)), 2)
    return F.array(*[F.xxhash64(F.lit(k), blocks[i], blocks[j]) for k, (i, j) in enumerate(pairs)])


def links(fps: DataFrame, radius: int = 3, limit: int = 512) -> DataFrame:
    """fps(fp), distinct -> (u, v) that connect all fingerprints within `radius` bits, as the full set of links would.

    Fingerprints meet where two of radius + 2 blocks of bits agree, which any two within the radius do. A bucket of
    more than `limit` is dealt into chunks, and each pair of chunks is compared in a task's block of its own: no
    block outgrows memory and no pair is missed, while the bucket's fingerprints are copied once a chunk. A null
    fingerprint meets none, an empty table gives no links, other columns are left alone.
    """
    rows = fps.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    chunks = F.ceil(F.col("m") / limit).cast("int")
    dealt = rows.join(sizes, "key").select("fp", "key", chunks.alias("n"), F.pmod(F.xxhash64("fp", "key"), chunks).cast("int").alias("own"))
    dealt = dealt.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            fp, block = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True))
            ends = np.flatnonzero(np.diff(block)) + 1  # a block that isn't over waits for the next batch
            cut = ends[-1] if len(ends) else 0
            yield from _compared(fp[:cut], ends[:-1], radius)
            held = fp[cut:], block[cut:]
        yield from _compared(held[0], np.zeros(0, np.int64), radius)

    ordered = dealt.repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _compared(fp: np.ndarray, ends: np.ndarray, radius: int, least: int = 256) -> Iterator[pa.RecordBatch]:
    """Whole blocks, small ones taken together: a link between two of them is a link too."""
    at = 0
    for end in [*ends.tolist(), len(fp)]:
        if end > at and (end - at >= least or end == len(fp)):
            u, v = forest(np.unique(fp[at:end]).view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
            at = end


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fp, component_id): one row per row of docs.

    component_id is the smallest id reachable over links of fingerprints that differ in `radius` bits at most. Null
    and empty texts have fingerprint 0, which links like any other. A null id stays null, belongs to its component
    and is never its smallest id (unless all its ids are null). Repeated rows give repeated rows; an empty table
    gives none. Other columns of docs are left alone.
    """
    own = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("id").alias("first"))
    classes = stored(classes, "classes")
    roots = connected(links(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """docs with one row of each component: of those with the smallest id, the one with the least fingerprint.

    Rows without an id are kept. Rows that share an id but not a component are told apart by their fingerprints; of
    rows that share both, the one with the least text stays. Null and empty texts have fingerprint 0 and are one
    component. Very long texts are read whole, ties fall to the least text, an empty table gives none, and columns
    may have any name: the row travels as one value.
    """
    names = docs.columns
    found = near_duplicates(docs, id_col, text_col, radius)
    stay = found.where("id is not null").groupBy("component_id").agg(F.min(F.struct("id", "fp")).alias("first")).where("first.id = component_id")
    stay = stay.select(F.col("first.id").alias("stay_id"), F.col("first.fp").alias("stay_fp"))
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    chosen = rows.join(stay, F.col("id") == F.col("stay_id")).select("id", "stay_fp", "row", F.col("row")[text_col].alias("text"))
    chosen = _matching(chosen)
    least = F.row_number().over(Window.partitionBy("id").orderBy(F.col("row")[text_col].asc_nulls_first()))  # rows of one id
    chosen = chosen.withColumn("place", least).where("place = 1").select("row")
    both = chosen.unionByName(rows.where("id is null").select("row"))
    return both.select(*[F.col("row")[n].alias(n) for n in names])


def _matching(chosen: DataFrame) -> DataFrame:
    """Of rows that share an id, those whose text has the fingerprint that stays. Ids that don't repeat aren't read."""
    repeated = chosen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = chosen.join(repeated, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text"), b.schema.get_field_index("stay_fp")
            fps = np.array([fingerprint(x.as_py()) for x in b.column(at[0])], np.uint64).view(np.int64)
            yield b.filter(pa.array(fps == b.column(at[1]).to_numpy()))

    return chosen.join(repeated, "id", "left_anti").unionByName(again.mapInArrow(run, again.schema))
