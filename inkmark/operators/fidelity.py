"""Visual information fidelity: what of a frame's information, by a Gaussian scale mixture of its bands, survives.

Every step is a window along rows or columns, an aggregate, or a join of blocks; the only rows that meet matrices are
one for each carrier and band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS
from inkmark.operators.neighbourhood import _along, paired
from inkmark.operators.pyramid import oriented_subbands
from inkmark.sources.scratch import stored

#: Scales and orientations that count, variance of what the eye adds, side of a block, and the bound
#: under which a variance is none.
HEIGHT, ORIENTATIONS, SIGMA, BLOCK, TOLERANCE = 4, (0, 3), 0.4, 3, 1e-15


def window_side(scale: int) -> int:
    """Finest first: 17, 9, 5, 3."""
    return 2 ** (HEIGHT - scale) + 1


def window_sums(plane: DataFrame, names: list[str], side: int, step: int = 1, edge: str = "reflect") -> DataFrame:
    """Sums over squares of an odd side around every step-th place from step // 2, at block resolution.

    Along the rows, then down the columns of what is left. Each is cut into pieces of `side` places with running sums
    from either end; a window is the end of one piece and the start of the next: two lookups, whatever the side. As
    nothing is subtracted, sums of next to nothing beside large values are as exact as added up one by one.

    edge: reflect mirrors what lies beyond the edges (a side of up to twice the frame), inside drops the squares
    that don't lie within the frame; blocks keep their numbers.
    """
    if edge not in ("reflect", "inside"):
        raise ValueError(f"unknown edge {edge}")
    h, start = side // 2, step // 2
    for axis in ("x", "y"):
        w, keep = _along(axis), "true"
        if edge == "reflect":
            n = F.max(axis).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
            at = f"explode(filter(array({axis}, -{axis}, 2 * (__n - 1) - {axis}), (p, i) -> i = 0 or i = 1 and p < 0 and p >= -{h} or i = 2 and p >= __n and p < __n + {h}))"
            plane = plane.withColumn("__n", n).withColumn("__at", F.expr(at)).drop(axis).withColumnRenamed("__at", axis)
            keep = f"{axis} + {h} < __n"
        line = ("carrier_id", "y" if axis == "x" else "x")
        piece = Window.partitionBy(*line, "__piece").orderBy(axis)
        up, down = piece.rowsBetween(Window.unboundedPreceding, Window.currentRow), piece.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        cut = plane.withColumn("__piece", F.floor(F.col(axis) / side).cast("int"))
        cut = cut.withColumns({f"__u_{c}": F.sum(c).over(up) for c in names} | {f"__d_{c}": F.sum(c).over(down) for c in names})
        ordered = Window.partitionBy(*line).orderBy("__piece", axis)  # the order that the pieces are in already
        to = {f"__t_{c}": F.lead(f"__u_{c}", 2 * h).over(ordered) if h else F.col(f"__u_{c}") for c in names}
        first = cut.withColumns(to).where(f"{keep} and {axis} + {h} >= {start} and ({axis} + {h} - {start}) % {step} = 0 and __t_{names[0]} is not null")
        own = {k: F.expr(f"cast(({k} + {h} - {start}) div {step} as int)") if k == axis else F.col(k) for k in KEYS}
        plane = first.select(*[c.alias(k) for k, c in own.items()], *[F.expr(f"if({axis} = __piece * {side}, __t_{c}, __d_{c} + __t_{c})").alias(c) for c in names])
    return plane


def frame_sizes(plane: DataFrame) -> DataFrame:
    """(carrier_id, height, width), stored: a row a frame, so that Spark knows its size and may broadcast it."""
    return stored(plane.groupBy("carrier_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")), "sizes")


def _sized(plane: DataFrame, scale: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """plane with a key (of, scale, height, width) for carrier_id: what every later step needs to know of a frame goes
    along in its key, so that sizes are joined once."""
    own = plane.join(frame_sizes(plane) if sizes is None else sizes, "carrier_id")
    key = F.struct(F.col("carrier_id").alias("of"), F.lit(scale).alias("scale"), "height", "width")
    return own.withColumn("carrier_id", key).select(*plane.columns)


def _at_scale(plane: DataFrame, scale: int) -> DataFrame:
    """The key of a scale of a plane whose key is of the finest."""
    half = lambda c: F.expr(f"cast((carrier_id.{c} + {2**scale - 1}) div {2**scale} as int)").alias(c)
    return plane.withColumn("carrier_id", F.struct("carrier_id.of", F.lit(scale).alias("scale"), half("height"), half("width")))


def _whole_blocks(sized: DataFrame, block: int) -> DataFrame:
    """Without the last rows and columns that don't fill a block."""
    return sized.where(f"y < carrier_id.height - carrier_id.height % {block} and x < carrier_id.width - carrier_id.width % {block}")


def _channel(sized: DataFrame, side: int, block: int, pairs: tuple[tuple[str, str], ...], edge: str) -> DataFrame:
    own = _whole_blocks(sized, block)
    five = {f"{a}{n}": e for a, b in pairs for n, e in (("_s", f"{a}"), ("_t", f"{b}"), ("_ss", f"{a} * {a}"), ("_tt", f"{b} * {b}"), ("_st", f"{a} * {b}"))}
    sums = window_sums(own.select(*KEYS, *[F.expr(e).alias(n) for n, e in five.items()]), list(five), side, block, edge)
    n, out = float(side * side), []
    for a, _ in pairs:
        sums = sums.withColumns({f"{a}_va": F.expr(f"greatest(0e0, {a}_ss - {a}_s * {a}_s / {n}D)"), f"{a}_vb": F.expr(f"greatest(0e0, {a}_tt - {a}_t * {a}_t / {n}D)"), f"{a}_c": F.expr(f"{a}_st - {a}_s * {a}_t / {n}D")})
        sums = sums.withColumn(f"{a}_g", F.expr(f"{a}_c / ({a}_va + {TOLERANCE}D)"))
        none = f"{a}_va < {TOLERANCE}D or {a}_vb < {TOLERANCE}D"
        gain = f"case when {none} or {a}_g < 0e0 then 0e0 else {a}_g end"
        noise = f"case when {a}_vb < {TOLERANCE}D then 0e0 when {a}_va < {TOLERANCE}D or {a}_g < 0e0 then {a}_vb else ({a}_vb - {a}_g * {a}_c) / {n}D end"
        out += [F.expr(gain).alias(f"gain_{a}"), F.expr(f"greatest({noise}, {TOLERANCE}D)").alias(f"noise_{a}")]
    return sums.select(*KEYS, *out)


def vifsub_est(bands: DataFrame, side: int, block: int = BLOCK, pairs: tuple[tuple[str, str], ...] = (("a", "b"),), edge: str = "reflect") -> DataFrame:
    """(carrier_id, y, x, gain_<a>, noise_<a> of each pair of columns): b as gain times a and noise, by block.

    Without variance of a all of b's is noise; without variance of b there is neither; a negative gain is none.
    """
    found = _channel(_sized(bands), side, block, pairs, edge)
    return found.withColumn("carrier_id", F.col("carrier_id.of"))


BAND = ("carrier_id", "scale", "orientation")


def _neighbourhoods(plane: DataFrame, names: list[str], block: int) -> DataFrame:
    """Each name as an array of the block * block values at and after each place, row by row; places near the end lack them."""
    w, h = _along("x"), _along("y")
    rows = plane.select(*KEYS, *[F.array(*[F.lead(c, j).over(w) if j else F.col(c) for j in range(block)]).alias(c) for c in names])
    last = [f"{c}[{block - 1}] is not null" for c in names[:1]]
    rows = rows.where(last[0])
    square = rows.select(*KEYS, *[F.flatten(F.array(*[F.lead(c, i).over(h) if i else F.col(c) for i in range(block)])).alias(c) for c in names])
    return square.where(f"{names[0]} is not null")  # flatten is null where a row lacks


def gram(bands: DataFrame, block: int = BLOCK) -> DataFrame:
    """bands(BAND..., p array) of overlapping neighbourhoods -> (BAND..., n, sums, products): sums of the values and of
    the products of two, upper half by row: one aggregate whose parts add up."""
    k = block * block
    p = [F.get("p", F.lit(i)) for i in range(k)]
    sums, products = [F.sum(c).alias(f"s{i}") for i, c in enumerate(p)], [F.sum(p[i] * p[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    found = bands.groupBy(*BAND).agg(F.count("*").alias("n"), *sums, *products)
    return found.select(*BAND, "n", F.array(*[f"s{i}" for i in range(k)]).alias("sums"), F.array(*[f"c{i}_{j}" for i in range(k) for j in range(i, k)]).alias("products"))


def eigen(grams: DataFrame, block: int = BLOCK) -> DataFrame:
    """grams -> (BAND..., inverse, eigenvalues falling) of their covariances, many at once; null where one has no
    inverse, as that of a flat band."""
    k = block * block
    upper = np.triu_indices(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c, n = np.zeros((len(b), k, k)), b["n"].to_numpy(float)[:, None]
            mean = np.stack(b["sums"]).reshape(-1, k) / n if len(b) else np.zeros((0, k))
            c[:, upper[0], upper[1]] = np.stack(b["products"]) / n if len(b) else 0
            c[:, upper[1], upper[0]] = c[:, upper[0], upper[1]]
            values, vectors = np.linalg.eigh(c - mean[:, :, None] * mean[:, None, :])
            fine = values[:, 0] > 1e-14 * values[:, -1]
            inverse = (vectors / np.where(fine[:, None], values, 1)[:, None, :]) @ vectors.transpose(0, 2, 1)
            yield b[list(BAND)].assign(inverse=[i.ravel() if f else None for i, f in zip(inverse, fine, strict=True)], eigenvalues=[v[::-1] if f else None for v, f in zip(values, fine, strict=True)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grams.schema if f.name in BAND)
    return grams.mapInPandas(run, f"{kinds}, inverse array<double>, eigenvalues array<double>")


def _blocks(bands: DataFrame, name: str, block: int) -> DataFrame:
    """(BAND..., y, x, p) of blocks that don't overlap, by block number, row by row."""
    at = F.col("y") % block * block + F.col("x") % block
    cells = [F.max(F.when(at == i, F.col(name))).alias(f"p{i}") for i in range(block * block)]
    by = [*BAND, F.expr(f"cast(y div {block} as int)").alias("y"), F.expr(f"cast(x div {block} as int)").alias("x")]
    return bands.groupBy(*by).agg(*cells).select(*BAND, "y", "x", F.array(*[f"p{i}" for i in range(block * block)]).alias("p"))


def _long(plane: DataFrame, orientations: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """(BAND..., y, x, names...) of a plane whose key is of a frame and a scale."""
    each = ", ".join(f"{k}, " + ", ".join(f"{c}_{k}" for c in names) for k in orientations)
    rows = plane.select(F.col("carrier_id.of").alias("carrier_id"), F.col("carrier_id.scale").alias("scale"), "y", "x", F.expr(f"stack({len(orientations)}, {each}) as (orientation, {', '.join(names)})"))
    return rows.select(*BAND, "y", "x", *names)


def _parameters(sized: DataFrame, orientations: tuple[int, ...], name: str, block: int) -> tuple[DataFrame, DataFrame]:
    names = [f"{name}_{k}" for k in orientations]
    own = _whole_blocks(sized.select(*KEYS, *names), block)
    near = _long(_neighbourhoods(own, names, block), orientations, (name,)).withColumnRenamed(name, "p")
    found = stored(eigen(gram(near, block), block), "covariances")
    blocks, k = _blocks(_long(own, orientations, (name,)), name, block), block * block
    form = " + ".join(f"get(p, {i}) * get(p, {j}) * {1 if i == j else 2} * get(inverse, {i * k + j})" for i in range(k) for j in range(i, k))
    placed = blocks.join(found.select(*BAND, "inverse"), list(BAND)).select(*BAND, "y", "x", F.expr(f"({form}) / {k}e0").alias("multiplier"))
    return placed, found.select(*BAND, "eigenvalues")


def refparams_vecgsm(scales: list[DataFrame], orientations: tuple[int, ...] = ORIENTATIONS, name: str = "v", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((BAND..., y, x, multiplier) by block, (BAND..., eigenvalues)) of bands by scale as oriented_subbands gives them.

    The covariance is of overlapping neighbourhoods, the multiplier of blocks that don't overlap: their quadratic form
    with the inverse covariance, over the number of values. Null where a band's covariance has no inverse. All scales
    share every window and aggregate.
    """
    return _parameters(reduce(DataFrame.unionByName, [_sized(s, i) for i, s in enumerate(scales)]), orientations, name, block)


def vif(first: DataFrame, second: DataFrame, block: int = BLOCK, sigma: float = SIGMA) -> DataFrame:
    """(carrier_id, vif, status) of two planes(keys, v); 1 where nothing is lost.

    Frames under 24 block sides have no value and the status too_small; without information in the first frame, as in
    a flat one, there is none and the status is flat. Blocks near the edges, as far as windows reach, don't count.
    """
    if block < 1 or sigma <= 0:
        raise ValueError("block and sigma must be positive")
    both = paired(first, second)
    sizes = frame_sizes(both)
    side = F.least("height", "width")
    own = oriented_subbands(_sized(both, 0, sizes.where(side >= 24 * block)), HEIGHT, ORIENTATIONS, ("a", "b"))
    scales = [_at_scale(s, i) for i, s in enumerate(own)]
    pairs, channel = tuple((f"a_{k}", f"b_{k}") for k in ORIENTATIONS), []
    for i, s in enumerate(scales):
        off = -(-(window_side(i) // 2) // block)
        found = _channel(s, window_side(i), block, pairs, "inside")
        found = found.where(f"y >= {off} and y < carrier_id.height div {block} - {off} and x >= {off} and x < carrier_id.width div {block} - {off}")
        channel.append(found.select(*KEYS, *[F.col(f"{n}_a_{k}").alias(f"{n}_{k}") for k in ORIENTATIONS for n in ("gain", "noise")]))
    lost = stored(_long(reduce(DataFrame.unionByName, channel), ORIENTATIONS, ("gain", "noise")), "channel")
    multiplier, values = _parameters(reduce(DataFrame.unionByName, scales), ORIENTATIONS, "a", block)
    blocks = lost.join(multiplier, [*BAND, "y", "x"]).join(values, list(BAND)).where("multiplier is not null")
    logs = lambda e: " + ".join(f"log2(1e0 + {e.format(f'get(eigenvalues, {i})')})" for i in range(block * block))
    kept = F.sum(F.expr(logs(f"gain * gain * multiplier * {{}} / (noise + {sigma}D)")))
    told = F.sum(F.expr(logs(f"multiplier * {{}} / {sigma}D")))
    scored = blocks.groupBy("carrier_id").agg(kept.alias("kept"), told.alias("told"))
    status = F.when(side < 24 * block, "too_small").when(F.col("told").isNull() | (F.col("told") == 0), "flat").otherwise("ok")
    out = sizes.join(scored, "carrier_id", "left").withColumn("status", status)
    return out.select("carrier_id", F.when(F.col("status") == "ok", F.col("kept") / F.col("told")).alias("vif"), "status")
