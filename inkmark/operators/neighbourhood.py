"""Filters over neighbouring pixels of a plane(carrier_id, y, x, v, ...), and the similarity maps built on them.

Windows are partitioned by a carrier's row or column, never by a carrier alone, so a large frame spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.functions import formulas as f
from inkmark.functions.formulas import KEYS

#: Constants of structural similarity for levels 0..255, and the weights of its five scales.
C1, C2, MS_WEIGHTS = (0.01 * 255) ** 2, (0.03 * 255) ** 2, (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
#: Scharr's kernel, and the stabilisers of the gradient and chroma similarities.
SCHARR_X = ((3 / 16, 0.0, -3 / 16), (10 / 16, 0.0, -10 / 16), (3 / 16, 0.0, -3 / 16))
SCHARR_Y = tuple(zip(*SCHARR_X, strict=True))
GRADIENT_C, CHROMA_C, CHROMA_POWER = 160.0, 200.0, 0.03
#: Side of the tiles in which frames are compared at all scales, and what a tile sees before and after it: 15 and 159
#: places at five scales, rounded up to multiples of 16, so that every scale of a tile begins at an even place.
SIDE, BEFORE, AFTER = 512, 16, 160


def gauss1d(size: int = 11, sigma: float = 1.5) -> list[float]:
    taps = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [t / sum(taps) for t in taps]


def luma_plane(pixels: DataFrame) -> DataFrame:
    return pixels.select(*KEYS, F.expr(f.luma()).alias("v"))


def _values(plane: DataFrame) -> list[str]:
    return [c for c in plane.columns if c not in KEYS]


def _along(axis: str) -> Window:
    return Window.partitionBy("carrier_id", "y" if axis == "x" else "x").orderBy(axis)


def _shifted(c: str, by: int, w: Window) -> Column:
    return F.lead(c, by).over(w) if by > 0 else F.lag(c, -by).over(w) if by < 0 else F.col(c)


def _pass(plane: DataFrame, taps: list[float], axis: str, mode: str) -> DataFrame:
    w, names, n = _along(axis), _values(plane), len(taps)
    if mode == "valid":
        sums = [sum((F.lit(t) * _shifted(c, i, w) for i, t in enumerate(taps)), F.lit(0.0)).alias(c) for c in names]
        return plane.select(*KEYS, *sums).where(f"{names[0]} is not null")
    sums = [sum((F.lit(t) * F.coalesce(_shifted(c, i - n // 2, w), F.lit(0.0)) for i, t in enumerate(taps)), F.lit(0.0)).alias(c) for c in names]
    return plane.select(*KEYS, *sums)


def sepfilter(plane: DataFrame, taps: list[float], mode: str = "valid") -> DataFrame:
    """Rows, then columns. valid: a frame shrinks by len(taps) - 1 to the top left; same: zeros lie around it."""
    if mode not in ("valid", "same"):
        raise ValueError(f"unknown mode {mode}")
    return _pass(_pass(plane, taps, "x", mode), taps, "y", mode)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(keys, a, b): two planes by place; a frame of which a place is missing on one side is an error."""
    a, b = first.select(*KEYS, F.col("v").alias("a"), F.lit(1).alias("ia")), second.select(*KEYS, F.col("v").alias("b"), F.lit(1).alias("ib"))
    joined = a.join(b, list(KEYS), "full_outer")
    same = F.when(F.col("ia").isNull() | F.col("ib").isNull(), F.raise_error(F.lit("frames differ in size")).cast(first.schema["v"].dataType))
    return joined.select(*KEYS, F.coalesce(same, F.col("a")).alias("a"), "b")


def ssim_map(first: DataFrame, second: DataFrame) -> DataFrame:
    """(keys, ssim, cs) by an 11-tap Gaussian: five products filtered in the same two passes."""
    return _ssim_of(paired(first, second))


def _ssim_of(both: DataFrame) -> DataFrame:
    five = both.select(*KEYS, "a", "b", F.expr("a * a").alias("aa"), F.expr("b * b").alias("bb"), F.expr("a * b").alias("ab"))
    m = sepfilter(five, gauss1d())
    m = m.select(*KEYS, F.expr("a * a").alias("ma"), F.expr("b * b").alias("mb"), F.expr("a * b").alias("mab"), "aa", "bb", "ab")
    cs = F.expr(f"(2e0 * (ab - mab) + {C2}) / ((aa - ma) + (bb - mb) + {C2})")
    return m.withColumn("cs", cs).select(*KEYS, F.expr(f"(2e0 * mab + {C1}) / (ma + mb + {C1}) * cs").alias("ssim"), "cs")


def ssim(first: DataFrame, second: DataFrame) -> DataFrame:
    """(carrier_id, ssim, status); frames under 11 pixels a side have no value and the status too_small."""
    means = _scale_means(first, second, 1).select("carrier_id", F.col("mean").alias("ssim"))
    return means.select("*", F.when(F.col("ssim").isNull(), "too_small").otherwise("ok").alias("status"))


def _scale_means(first: DataFrame, second: DataFrame, scales: int) -> DataFrame:
    """(carrier_id, k, mean) of cs at each scale, of ssim at the last one; null where a frame is too small for it.

    Both frames are cut into tiles of SIDE with BEFORE and AFTER more rows and columns of their neighbours, which is
    what five scales of an interior see. A batch's pixels of a tile are packed before the one shuffle, all scales follow
    in the task that has the tile, and leave a sum each: no scale is written or shuffled, no frame has to fit into a task.
    """
    kind = first.schema["carrier_id"].dataType.simpleString()
    each = [p.select(*KEYS, F.col("v").cast("double").alias("v"), F.lit(i).alias("side")) for i, p in enumerate((first, second))]
    packed = reduce(DataFrame.unionByName, each).mapInArrow(_packed, f"carrier_id {kind}, ty int, tx int, side int, at binary, v binary")
    sums = packed.groupBy("carrier_id", "ty", "tx").applyInArrow(lambda part: _tile_sums(part, scales), f"carrier_id {kind}, k int, total double, n long")
    mean = F.when(F.sum("n") > 0, F.sum("total") / F.sum("n"))
    return sums.groupBy("carrier_id", "k").agg(mean.alias("mean"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(carrier_id, ty, tx, side, at, v): of each batch and tile the places, as steps between sorted ones, and values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        y, x, v, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        y, x = y.astype(np.int64), x.astype(np.int64)
        near = [[(t, (t >= 0) & (a >= t * SIDE - BEFORE) & (a < (t + 1) * SIDE + AFTER)) for t in (a // SIDE + i for i in (-1, 0, 1))] for a in (y, x)]
        seen = [(np.flatnonzero(sy & sx), ty, tx) for ty, sy in near[0] for tx, sx in near[1]]
        row = np.concatenate([r for r, _, _ in seen])
        ty, tx = np.concatenate([ty[r] for r, ty, _ in seen]), np.concatenate([tx[r] for r, _, tx in seen])
        at = (y[row] - np.maximum(0, ty * SIDE - BEFORE)) * (SIDE + BEFORE + AFTER) + x[row] - np.maximum(0, tx * SIDE - BEFORE)
        which = coded.indices.to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((at, side[row], tx, ty, which))
        row, at, tags = row[order], at[order], np.stack([which, ty, tx, side[row]])[:, order]
        cuts = np.concatenate([[0], np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(0)) + 1, [len(row)]])
        parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        heads = tags[:, cuts[:-1]]
        columns = [coded.dictionary.take(pa.array(heads[0])), *(pa.array(h.astype(np.int32)) for h in heads[1:])]
        columns.append(pa.array([np.diff(at[p], prepend=0).astype(np.int32).tobytes() for p in parts], pa.binary()))
        columns.append(pa.array([v[row[p]].astype(float).tobytes() for p in parts], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["carrier_id", "ty", "tx", "side", "at", "v"])


def _tile_sums(part: pa.Table, scales: int) -> pa.Table:
    """(carrier_id, k, total, n) of a tile's interior at each scale."""
    wide = SIDE + BEFORE + AFTER
    planes, there = np.full((2, wide * wide), np.nan), np.zeros((2, wide * wide), bool)
    for side, at, v in zip(*(part[c].to_pylist() for c in ("side", "at", "v")), strict=True):
        places = np.cumsum(np.frombuffer(at, np.int32))
        planes[side, places], there[side, places] = np.frombuffer(v), True
    if (there[0] != there[1]).any():
        raise ValueError("frames differ in size")
    used = there[0].reshape(wide, wide)
    height, width = (int(np.flatnonzero(used.any(i)).max()) + 1 for i in (1, 0))
    planes = planes.reshape(2, wide, wide)[:, :height, :width]
    skipped = [BEFORE if part[c][0].as_py() else 0 for c in ("ty", "tx")]
    totals, counts, taps = [], [], gauss1d()
    for k in range(scales):
        at = [slice(s >> k, (s + SIDE) >> k) for s in skipped]
        found = _ssim_of_arrays(*planes, taps)[k < scales - 1][at[0], at[1]] if min(planes.shape[1:]) >= len(taps) else np.zeros((0, 0))
        valid = found[~np.isnan(found)]
        totals.append(float(valid.sum()))
        counts.append(valid.size)
        for axis in (2, 1):  # as downsample2
            before = np.concatenate([planes.take([0], axis), planes.take(range(planes.shape[axis] - 1), axis)], axis)
            planes = (before + planes) / 2
        planes = planes[:, ::2, ::2]
    ids = part["carrier_id"].combine_chunks().take(pa.array(np.zeros(scales, np.int64)))
    return pa.table([ids, pa.array(range(scales), pa.int32()), pa.array(totals), pa.array(counts, pa.int64())], ["carrier_id", "k", "total", "n"])


def _ssim_of_arrays(a: np.ndarray, b: np.ndarray, taps: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """ssim and cs of two planes, as _ssim_of."""

    def filtered(m: np.ndarray) -> np.ndarray:
        n = m.shape[1] - len(taps) + 1
        m = sum(t * m[:, i : i + n] for i, t in enumerate(taps))
        n = m.shape[0] - len(taps) + 1
        return sum(t * m[i : i + n] for i, t in enumerate(taps))

    ma, mb, aa, bb, ab = map(filtered, (a, b, a * a, b * b, a * b))
    cs = (2 * (ab - ma * mb) + C2) / ((aa - ma * ma) + (bb - mb * mb) + C2)
    return (2 * (ma * mb) + C1) / (ma * ma + mb * mb + C1) * cs, cs


def downsample2(plane: DataFrame) -> DataFrame:
    """Means of two by two, the edge repeated at the top and left, at even places."""
    for axis in ("x", "y"):
        w = _along(axis)
        plane = plane.select(*KEYS, *[((F.coalesce(F.lag(c).over(w), F.col(c)) + F.col(c)) / 2).alias(c) for c in _values(plane)])
    even = plane.where("y % 2 = 0 and x % 2 = 0")
    return even.select("carrier_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), *_values(plane))


def ms_ssim(first: DataFrame, second: DataFrame) -> DataFrame:
    """(carrier_id, ms_ssim, status); frames under 176 pixels a side have no value and the status too_small."""
    means = _scale_means(first, second, len(MS_WEIGHTS))
    each = means.select("carrier_id", F.pow(F.greatest("mean", F.lit(1e-8)), F.get(F.array(*map(F.lit, MS_WEIGHTS)), F.col("k"))).alias("s"), F.col("mean").isNull().alias("lacks"))
    scored = each.groupBy("carrier_id").agg(F.product("s").alias("s"), F.bool_or("lacks").alias("lacks"))
    value = F.when(~F.col("lacks"), F.col("s"))
    return scored.select("carrier_id", value.alias("ms_ssim"), F.when(F.col("lacks"), "too_small").otherwise("ok").alias("status"))


def conv3(plane: DataFrame, kernels: dict[str, tuple], names: tuple[str, ...] = ("v",)) -> DataFrame:
    """Correlations with 3 * 3 kernels by name, the edge repeated; of several columns as <kernel>_<column>, in the same windows."""
    w, h = _along("x"), _along("y")
    rows = plane.select(*KEYS, *[c.alias(f"{n}{j}") for n in names for j, c in enumerate((F.coalesce(F.lag(n).over(w), F.col(n)), F.col(n), F.coalesce(F.lead(n).over(w), F.col(n))))])
    near = rows.select(*KEYS, *[F.coalesce(_shifted(f"{n}{j}", i - 1, h), F.col(f"{n}{j}")).alias(f"{n}{i}{j}") for n in names for i in range(3) for j in range(3)])
    return near.select(*KEYS, *[sum((F.lit(float(k[i][j])) * F.col(f"{n}{i}{j}") for i in range(3) for j in range(3) if k[i][j]), F.lit(0.0)).alias(kernel if len(names) == 1 else f"{kernel}_{n}") for n in names for kernel, k in kernels.items()])


def scharr_gradient(plane: DataFrame) -> DataFrame:
    """(keys, v): the gradient's length."""
    both = conv3(plane, {"h": SCHARR_X, "w": SCHARR_Y})
    return both.select(*KEYS, F.expr("sqrt(h * h + w * w)").alias("v"))


def gradient_similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """(carrier_id, similarity) of the planes' gradients; paired first, so that both are filtered in the same windows."""
    both = conv3(paired(first, second), {"h": SCHARR_X, "w": SCHARR_Y}, ("a", "b"))
    lengths = both.select("carrier_id", *[F.expr(f"sqrt(h_{c} * h_{c} + w_{c} * w_{c})").alias(c) for c in "ab"])
    return lengths.groupBy("carrier_id").agg(F.avg(F.expr(f"(2e0 * a * b + {GRADIENT_C}) / (a * a + b * b + {GRADIENT_C})")).alias("similarity"))


def along(plane: DataFrame, outs: dict[str, list[tuple[str, list[float]]]], axis: str, edge: str = "reflect", start: int = 0, step: int = 1) -> DataFrame:
    """Filters along an axis: each out is a sum over (column, taps) of near values times taps, centred at len // 2.

    Near values are lags and leads within a carrier's row or column; places beyond the edges are mirrored (reflect:
    the last isn't repeated; symmetric: it is), again and again in a short one. Computed at every step-th place from
    start, which are numbered anew.
    """
    if edge not in ("reflect", "symmetric"):
        raise ValueError(f"unknown edge {edge}")
    reach = max(len(taps) // 2 for parts in outs.values() for _, taps in parts)
    w, names = _along(axis), list(dict.fromkeys(c for parts in outs.values() for c, _ in parts))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = plane.select(*KEYS, (F.max(axis).over(whole) + 1).alias("__n"), *[F.array(*[_shifted(c, i, w) for i in range(-reach, reach + 1)]).alias(c) for c in names])
    near = near.where((F.col(axis) >= start) & ((F.col(axis) - start) % step == 0))
    round_trip = "greatest(1, 2 * (__n - 1))" if edge == "reflect" else "2 * __n"
    back = "2 * (__n - 1)" if edge == "reflect" else "2 * __n - 1"
    at = [f"pmod({axis} + {i}, {round_trip})" for i in range(-reach, reach + 1)]
    places = [F.expr(f"int(if({m} < __n, {m}, {back} - {m}) - {axis} + {reach})").alias(f"__p{i}") for i, m in enumerate(at)]
    near = near.select(*KEYS, F.expr(f"{axis} >= {reach} and {axis} + {reach} < __n").alias("__inside"), *places, *names)
    near = near.select(*KEYS, *[F.expr(f"if(__inside, {c}, array({', '.join(f'get({c}, __p{i})' for i in range(len(at)))}))").alias(c) for c in names])
    own = {n: F.expr(f"cast(({n} - {start}) div {step} as int)") if n == axis else F.col(n) for n in KEYS}
    sums = {out: [F.lit(float(t)) * F.get(F.col(c), F.lit(reach - len(taps) // 2 + i)) for c, taps in parts for i, t in enumerate(taps) if t] for out, parts in outs.items()}
    return near.select(*[c.alias(n) for n, c in own.items()], *[sum(terms[1:], terms[0]).alias(out) if terms else F.lit(0.0).alias(out) for out, terms in sums.items()])


def correlate(plane: DataFrame, kernel: list[list[float]], step: int = 1, start: int = 0, edge: str = "reflect") -> DataFrame:
    """Correlation at every step-th place from start; edge: reflect (not repeating the last) or symmetric (repeating it).

    A row of the kernel is a filter along the rows of the frame, equal ones are computed once; their sums down the
    columns are the second pass. Only the places asked for go from one to the other.
    """
    lines = [tuple(float(w) for w in row) for row in kernel]
    unlike = list(dict.fromkeys(lines))
    rows = along(plane, {f"c{k}": [("v", list(line))] for k, line in enumerate(unlike)}, "x", edge, start, step)
    return along(rows, {"v": [(f"c{k}", [float(line == own) for line in lines]) for k, own in enumerate(unlike)]}, "y", edge, start, step)


def downsample_box(plane: DataFrame, factor: int, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """Means of boxes, the edge repeated, at every factor-th place; of all columns in the same windows."""
    if factor <= 1:
        return plane.select(*KEYS, *names)
    for axis in ("x", "y"):
        plane = along(plane, {c: [(c, [1 / factor] * factor)] for c in names}, axis, "symmetric", 0, factor)
    return plane


def chroma_similarity(first: DataFrame, second: DataFrame, factor: int = 1) -> DataFrame:
    """(carrier_id, similarity) of I and Q of two sets of pixels, shrunk by a factor. One join, of the pixels."""
    a, b = (p.select(*KEYS, F.struct(F.expr(f.yiq_i()).alias("i"), F.expr(f.yiq_q()).alias("q")).alias("v")) for p in (first, second))
    both = paired(a, b).select(*KEYS, *[F.col(f"{s}.{c}").alias(f"{c}{s}") for s in "ab" for c in "iq"])
    small = downsample_box(both, factor, ("ia", "ib", "qa", "qb"))
    alike = {c: F.expr(f"(2e0 * {c}a * {c}b + {CHROMA_C}) / ({c}a * {c}a + {c}b * {c}b + {CHROMA_C})") for c in "iq"}
    both = small.select("carrier_id", (alike["i"] * alike["q"]).alias("c"))
    return both.groupBy("carrier_id").agg(F.avg(F.expr(f"sign(c) * pow(abs(c), {CHROMA_POWER}e0)")).alias("similarity"))
