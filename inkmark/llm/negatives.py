"""Hard negatives by exact inner products: cover trees over norm-augmented vectors, searched best node first.

An entry makes all candidates equally long, so inner products with an anchor fall as angles grow, and a node whose
points all lie within an angle of its centre bounds the products below it from both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.llm.common import stored

#: Rows of the sample that the top of the tree is fitted on, cells at its end, least and most rows of a block, anchors
#: that meet a block in one task, rows of a leaf on average, anchors whose blocks are chosen at once.
SAMPLE, CELLS, LEAST, MOST, CHUNK, LEAF, ROUND = 4096, 1024, 512, 65_536, 16_384, 96, 64


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, values = len(lists), lists.flatten().to_numpy(zero_copy_only=False)
    if n and (np.diff(lists.offsets.to_numpy()) != len(values) // n).any():  # flatten() heeds a slice, as offsets do
        raise ValueError("vectors differ in length")
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Directions of the vectors after an entry has made each as long as the longest; of nothing but zeros, of that entry."""
    x = x.astype(float)
    square = (x * x).sum(1)
    y = np.column_stack([x, np.sqrt(np.maximum(longest * longest - square, 0))])
    size = np.linalg.norm(y, axis=1, keepdims=True)
    y[size[:, 0] == 0, -1] = 1
    return y / np.where(size == 0, 1, size)


def spread(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres by farthest-first choice, how far each lay from those before it, and each point's nearest centre.

    Distances fall along the choice, so the centres before any point of it are a net: farther apart than the next
    distance, with every point within it.
    """
    centres, gaps, near = [0], [2.0], points @ points[0]
    whose = np.zeros(len(points), np.int64)
    while len(centres) < most:
        j = int(near.argmin())
        gap = float(np.sqrt(max(0.0, 2 - 2 * near[j])))
        if gap < 1e-7:
            break
        to = points @ points[j]
        nearer = to > near
        near[nearer], whose[nearer] = to[nearer], len(centres)
        centres.append(j)
        gaps.append(gap)
    return np.array(centres), np.array(gaps), whose


@dataclass
class CoverTree:
    """Nodes level by level: centre (a direction), angle that covers all points below, children, and the rows
    begin..end of a leaf. `order` puts the points of a leaf together."""

    centres: np.ndarray
    angles: np.ndarray
    children: list[list[int]]
    begin: np.ndarray
    end: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(points: np.ndarray, leaves: int) -> CoverTree:
        """Scales halve from level to level; a level that adds no centre is left out."""
        chosen, gaps, leaf = spread(points, leaves)
        sizes, scale = [], 2.0
        while not sizes or sizes[-1] < len(chosen):
            n = int((gaps > scale / 2).sum()) if scale > 1e-7 else len(chosen)
            if n > 0 and (not sizes or n > sizes[-1]):
                sizes.append(n)
            scale /= 2
        if sizes[0] > 1:
            sizes.insert(0, 1)
        centre = points[chosen]
        own, parent, angles, children, offset = leaf, [], [], [], np.cumsum([0, *sizes])
        for k in range(len(sizes) - 1, -1, -1):  # the ancestor of each point by level, from the leaves up
            n = sizes[k]
            cos = np.einsum("ij,ij->i", points, centre[own])
            widest = np.full(n, 1.0)
            np.minimum.at(widest, own, cos)
            angles.insert(0, np.arccos(np.clip(widest, -1, 1)))
            below = [[] for _ in range(n)]
            if k + 1 < len(sizes):
                for i, p in enumerate(parent):
                    below[p].append(int(offset[k + 1] + i))
            children = below + children
            if k:
                up = (centre[:n] @ centre[: sizes[k - 1]].T).argmax(1)
                up[: sizes[k - 1]] = np.arange(sizes[k - 1])  # nets are nested
                parent, own = up, up[own]
        order = np.argsort(leaf, kind="stable")
        count = np.bincount(leaf, minlength=len(chosen))
        end = np.cumsum(count)
        nodes = np.concatenate([centre[:n] for n in sizes])
        at = lambda v: np.concatenate([np.zeros(offset[-2], np.int64), v])
        return CoverTree(nodes, np.concatenate(angles), children, at(end - count), at(end), order)

    def bounds(self, directions: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each anchor with a point of each node; a little wider, for rounding."""
        angle = np.arccos(np.clip(directions @ self.centres.T, -1, 1))
        slack = 1e-6 * scales[:, None]
        low, high = np.cos(np.minimum(np.pi, angle + self.angles)), np.cos(np.maximum(0, angle - self.angles))
        return low * scales[:, None] - slack, high * scales[:, None] + slack


def descend(tree: CoverTree, least: np.ndarray, most: np.ndarray, windows: list[list], k: int, scores) -> list[list[tuple]]:
    """The k best (score, id) of each window [low, high], score falling, then id rising.

    scores(begin, end) -> (scores, ids) of a leaf's eligible rows. The node with the highest bound comes first; nodes
    outside of all windows, or under what all windows have found, are skipped.
    """
    found, low = [[] for _ in windows], [w[0] for w in windows]
    high = [w[1] for w in windows]
    heap = [(-most[0], 0)]
    while heap:
        upper, node = heappop(heap)
        if -upper < min(low):
            break
        if tree.children[node]:
            for c in tree.children[node]:
                if any(most[c] >= a and least[c] <= b for a, b in zip(low, high, strict=True)):
                    heappush(heap, (-most[c], c))
            continue
        s, ids = scores(tree.begin[node], tree.end[node])
        some = (s >= min(low)) & (s <= max(high))
        if not some.any():
            continue
        s, ids = s[some], ids[some]
        for i in range(len(windows)):
            mine = np.flatnonzero((s >= low[i]) & (s <= high[i]))
            if len(mine):
                if len(mine) > k:
                    mine = mine[np.lexsort((ids[mine], -s[mine]))[:k]]
                found[i] = sorted([*found[i], *((-int(s[j]), int(ids[j])) for j in mine)])[:k]
                if len(found[i]) == k:
                    low[i] = max(low[i], -found[i][-1][0])
    return [[(-s, i) for s, i in f] for f in found]


def _search(blocks: DataFrame, asks: DataFrame, longest: float, k: int, same: bool) -> DataFrame:
    """(a, anchor_id, window, id, score): the k best rows of each block for each window of the anchors that visit it.

    blocks(cell, part, chunk, key, id, label, x); asks(cell, part, chunk, a, anchor_id, anchor_label, ax, low, high).
    """
    exact = longest * longest < 2**52

    def run(block: pa.Table, ask: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and ask.num_rows:
            _, first = np.unique(block["key"].to_numpy(), return_index=True)  # repeated rows count once
            block = block.take(np.sort(first))
            x, ids, labels, keys = _matrix(block["x"]), block["id"].to_numpy(), block["label"].to_numpy(), block["key"].to_numpy()
            tree = CoverTree.of(augmented(x, longest), max(1, len(x) // LEAF))
            x, ids, labels, keys = (v[tree.order] for v in (x, ids, labels, keys))
            ax = _matrix(ask["ax"])
            if ax.shape[1] != x.shape[1]:
                raise ValueError("vectors differ in length")
            size = np.linalg.norm(ax.astype(float), axis=1)
            directions = np.column_stack([ax / np.where(size == 0, 1, size)[:, None], np.zeros(len(ax))])
            if exact:
                x, ax = x.astype(float), ax.astype(float)
            own, of = ask["a"].to_numpy(), ask["anchor_label"].to_numpy()
            lows, highs, names = ask["low"].to_pylist(), ask["high"].to_pylist(), ask["anchor_id"].to_pylist()
            for begin in range(0, len(ax), 1024):
                least, most = tree.bounds(directions[begin : begin + 1024], size[begin : begin + 1024] * longest)
                for i in range(begin, min(begin + 1024, len(ax))):
                    fits = ((labels == of[i]) & (keys != own[i])) if same else labels != of[i]

                    def scores(b, e, a=ax[i], fits=fits):
                        s = x[b:e] @ a
                        return s[fits[b:e]], ids[b:e][fits[b:e]]

                    got = descend(tree, least[i - begin], most[i - begin], list(zip(lows[i], highs[i], strict=True)), k, scores)
                    out += [(own[i], names[i], w, r, s) for w, each in enumerate(got) for s, r in each]
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "anchor_id", "window", "id", "score"])

    by = ["cell", "part", "chunk"]
    return blocks.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(run, "a long, anchor_id long, window int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a", "anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Index:
    """All rows in blocks(cell, part, key, id, label, x) and the top of the tree: a bounded sample, its cells' centres
    and the angle that covers every row of a cell."""

    rows: DataFrame | None
    longest: float
    x: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    centres: np.ndarray
    angles: np.ndarray
    parts: list[int]

    def asks(self, anchors: DataFrame, k: int, same: bool, chunks: int) -> DataFrame:
        """anchors(a, anchor_id, anchor_label, ax, low, high) once for each block that may hold a row of a window.

        The sample's rows give each window a first bound: its k-th best eligible row of the sample.
        """
        me, top = replace(self, rows=None), CoverTree(self.centres, self.angles, [], np.zeros(0), np.zeros(0), np.zeros(0))

        def run(batches):
            exact = me.longest * me.longest < 2**52
            for b in (whole.slice(i, ROUND) for whole in batches for i in range(0, whole.num_rows, ROUND)):
                ax, own, of = _matrix(b.column("ax")), b.column("a").to_numpy(), b.column("anchor_label").to_numpy()
                size = np.linalg.norm(ax.astype(float), axis=1)
                directions = np.column_stack([ax / np.where(size == 0, 1, size)[:, None], np.zeros(len(ax))])
                least, most = top.bounds(directions, size * me.longest)
                known = (ax.astype(float) @ me.x.T.astype(float)).astype(np.int64) if exact else ax @ me.x.T
                take, cells, lows = [], [], []
                for i, (low, high) in enumerate(zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)):
                    s = known[i][((me.labels == of[i]) & (me.keys != own[i])) if same else me.labels != of[i]]
                    first = []
                    for lo, hi in zip(low, high, strict=True):
                        t = s[(s >= lo) & (s <= hi)]
                        first.append(int(np.partition(t, -k)[-k]) if len(t) >= k else lo)
                    hit = np.flatnonzero(((most[i][:, None] >= first) & (least[i][:, None] <= high)).any(1))
                    take += [i] * len(hit)
                    cells += hit.tolist()
                    lows += [first] * len(hit)
                chosen = b.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *[chosen.column(c) for c in ("a", "anchor_id", "anchor_label", "ax")], pa.array(lows, pa.list_(pa.int64())), chosen.column("high")], ["cell", "a", "anchor_id", "anchor_label", "ax", "low", "high"])

        schema = "cell int, a long, anchor_id long, anchor_label long, ax array<bigint>, low array<bigint>, high array<bigint>"
        each = anchors.select("a", "anchor_id", "anchor_label", "ax", "low", "high").mapInArrow(run, schema)
        parts = F.array(*[F.lit(p) for p in self.parts])
        each = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)))
        return each.withColumn("chunk", F.pmod(F.col("a"), F.lit(chunks)).cast("int"))


def index(rows: DataFrame) -> Index | None:
    """Of rows(key, id, label, x), all of them; None without rows.

    The top is fitted on SAMPLE rows by hash at most, which come to the driver; a cell is of the rows nearest to a
    centre. Cells of more rows than a block are dealt out by hash, so a crowd of like vectors fills many blocks.
    """
    square = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda s, v: s + v.cast("decimal(19,0)") * v.cast("decimal(19,0)"))
    total = rows.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not total.n:
        return None
    if total.least != total.most:
        raise ValueError("vectors differ in length")
    if total.square >= 2**62:
        raise ValueError("inner products don't fit into 64 bits")
    longest = float(total.square) ** 0.5
    sample = rows.orderBy(F.xxhash64("key", F.lit("sample")), "key").limit(SAMPLE).select("key", "label", "x").toArrow()
    x = _matrix(sample["x"])
    points = augmented(x, longest)
    chosen, _, _ = spread(points, min(CELLS, max(1, total.n // LEAST)))
    centres = points[chosen]

    def run(batches):
        for b in batches:
            if b.num_rows:
                cos = augmented(_matrix(b.column("x")), longest) @ centres.T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cos.argmax(1), pa.int32()), pa.array(cos.max(1), pa.float64())], [*b.schema.names, "cell", "cos"])

    dealt = stored(rows.select("key", "id", "label", "x").mapInArrow(run, "key long, id long, label long, x array<bigint>, cell int, cos double"), "cells")
    size = max(LEAST, min(MOST, 2 * total.n // len(centres)))
    angles, parts = np.zeros(len(centres)), [1] * len(centres)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("cos").alias("cos")).collect():  # a row a cell
        angles[r.cell], parts[r.cell] = np.arccos(max(-1.0, min(1.0, r.cos))) + 1e-7, -(-r.n // size)
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.get(F.array(*[F.lit(p) for p in parts]), F.col("cell"))).cast("int")
    return Index(dealt.select("cell", part.alias("part"), "key", "id", "label", "x"), longest, x, sample["label"].to_numpy(), sample["key"].to_numpy(), centres, angles, parts)


def _within(found: Index, anchors: DataFrame, k: int, same: bool, n_anchors: int) -> DataFrame:
    chunks = -(-n_anchors // CHUNK)
    blocks = found.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return _best(_search(blocks, found.asks(anchors, k, same, chunks), found.longest, k, same), k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "x") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): exact, nothing is approximated.

    vector_col holds integers. An anchor's positives are its first other rows of the same label by inner product, ties
    by id; of each, the negatives are the first rows of other labels that score between low and high percent of the
    positive's score. is_anchor is a condition on the columns of rows.

    Rows with a null id, label or vector, or a null in it, take no part; vectors of unlike lengths are an error. Rows
    equal in id, label and vector count once; rows that share only an id are rows of their own. Without rows, anchors,
    positives or rows in the window, there are no rows. Columns of other names are left alone.
    """
    v = F.col(vector_col)
    own = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull()))
    own = own.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.cast("array<bigint>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    own = stored(own.withColumn("key", F.xxhash64("id", "label", "x")), "vectors")
    found, kinds = index(own), "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    anchors = own.where("anchor").select(F.col("key").alias("a"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("x").alias("ax")).dropDuplicates(["a"])
    n = anchors.count() if found else 0
    if not n:
        return own.sparkSession.createDataFrame([], kinds)
    least = F.array(F.lit(-(2**62)).cast("bigint"))
    wide = anchors.withColumns({"low": least, "high": F.array(F.lit(2**62).cast("bigint"))})
    first = stored(_within(found, wide, positives, True, n), "positives")
    each = first.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # `positives` at most
    asks = anchors.join(each, "a").withColumns({
        "low": F.expr(f"transform(p, q -> cast(ceil(cast(q.score as decimal(20,0)) * {low} / 100) as bigint))"),
        "high": F.expr(f"transform(p, q -> cast(floor(cast(q.score as decimal(20,0)) * {high} / 100) as bigint))"),
    })
    got = _within(found, asks, negatives, False, n)
    names = first.select("a", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return got.join(names, ["a", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
