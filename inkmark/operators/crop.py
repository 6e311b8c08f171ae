"""Cropping: padded, raw, or stretched back to the old size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB, level, uniform
from inkmark.operators.point import others
from inkmark.sources.carriers import sizes

#: Per position: where the region begins, as a share of the free rows and columns (in halves).
POSITIONS = {"top_left": (0, 0), "top_right": (0, 2), "bottom_left": (2, 0), "bottom_right": (2, 2), "center": (1, 1), "random": (None, None)}
#: Per resampling filter: its reach, and its weight at distance d.
RESAMPLE = {
    "bilinear": (1, "greatest(1e0 - abs(d), 0e0)"),
    "bicubic": (2, "case when abs(d) < 1e0 then (1.5e0 * abs(d) - 2.5e0) * d * d + 1e0 when abs(d) < 2e0 then ((-0.5e0 * abs(d) + 2.5e0) * abs(d) - 4e0) * abs(d) + 2e0 else 0e0 end"),
    "lanczos": (3, "case when d = 0e0 then 1e0 when abs(d) < 3e0 then 3e0 * sin(3.141592653589793e0 * d) * sin(3.141592653589793e0 * d / 3e0) / (3.141592653589793e0 * 3.141592653589793e0 * d * d) else 0e0 end"),
}


def region(pixels: DataFrame, ratio: float = 0.5, position: str = "center", seed: int = 0) -> DataFrame:
    """(carrier_id, height, width, kh, kw, top, left): the kept rectangle of each carrier."""
    if not 0 < ratio <= 1 or position not in POSITIONS:
        raise ValueError(f"bad ratio {ratio} or position {position}")
    out = sizes(pixels)
    for size, kept in (("height", "kh"), ("width", "kw")):
        out = out.withColumn(kept, F.expr(f"greatest(1, least({size}, cast(bround({size} * {float(ratio)}e0, 0) as int)))"))
    for size, kept, start, half in zip(("height", "width"), ("kh", "kw"), ("top", "left"), POSITIONS[position], strict=True):
        if half is None:
            u = uniform(f"concat_ws(':', '{seed}', cast(carrier_id as string), '{start}')")
            out = out.withColumn(start, F.expr(f"cast(floor({u} * ({size} - {kept} + 1)) as int)"))
        else:
            out = out.withColumn(start, F.expr(f"({size} - {kept}) * {half} div 2").cast("int"))
    return out


def _inside() -> F.Column:
    return F.expr("y >= top and y < top + kh and x >= left and x < left + kw")


def _fill(fill: int | tuple[int, int, int]) -> tuple[int, int, int]:
    triple = (fill,) * 3 if isinstance(fill, int) else tuple(fill)
    if len(triple) != 3 or not all(0 <= v <= 255 for v in triple):
        raise ValueError(f"bad fill {fill}")
    return triple


def crop_pad(pixels: DataFrame, ratio: float = 0.5, position: str = "center", fill: int | tuple[int, int, int] = 0, seed: int = 0) -> DataFrame:
    """The size stays; pixels outside the region take the fill."""
    triple = _fill(fill)
    own = pixels.join(region(pixels, ratio, position, seed), "carrier_id")
    return own.select(*others(pixels), *[F.when(_inside(), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in zip(RGB, triple, strict=True)])


def crop_raw(pixels: DataFrame, ratio: float = 0.5, position: str = "center", seed: int = 0) -> DataFrame:
    """The region alone, moved to the origin."""
    own = pixels.join(region(pixels, ratio, position, seed), "carrier_id").where(_inside())
    return own.select("carrier_id", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"), *RGB)


def crop_resize(pixels: DataFrame, ratio: float = 0.5, position: str = "center", resample: str = "bilinear", seed: int = 0) -> DataFrame:
    """The region stretched to the old size, columns first; rows between the passes aren't rounded.

    Each source pixel is sent to the few places that it reaches: a generator by row, no join with a grid.
    """
    cut = region(pixels, ratio, position, seed)
    own = pixels.join(cut, "carrier_id").where(_inside())
    own = own.select("carrier_id", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"), "height", "width", "kh", "kw", *RGB)
    if resample == "nearest":
        for a, size, kept in (("y", "height", "kh"), ("x", "width", "kw")):
            near = f"filter(sequence(cast(floor({a} * {size} / {kept}) as int) - 1, cast(ceil(({a} + 1) * {size} / {kept}) as int) + 1), t -> t >= 0 and t < {size} and cast(floor((t + 0.5e0) * {kept} / {size}) as int) = {a})"
            own = own.withColumn(a, F.explode(F.expr(near)))
        return own.select(*KEYS, *RGB)
    if resample not in RESAMPLE:
        raise ValueError(f"unknown filter {resample}")
    for a, size, kept, other in (("x", "width", "kw", "y"), ("y", "height", "kh", "x")):
        reach, weight = RESAMPLE[resample]
        near = f"filter(sequence(cast(floor(({a} - {reach}) * {size} / {kept}) as int) - 1, cast(ceil(({a} + 1 + {reach}) * {size} / {kept}) as int) + 1), t -> t >= 0 and t < {size})"
        sent = own.withColumn("t", F.explode(F.expr(near))).withColumn("d", F.expr(f"{a} + 0.5e0 - (t + 0.5e0) * {kept} / {size}")).withColumn("w", F.expr(weight)).where("w <> 0e0")
        total = [(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in RGB]
        own = sent.groupBy("carrier_id", other, F.col("t").alias(a), "height", "width", "kh", "kw").agg(*total)
    return own.select(*KEYS, *[F.expr(level(f"round({c}, 6)")).alias(c) for c in RGB])
