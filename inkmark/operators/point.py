"""Distortions of colour that need a pixel and at most one number of its carrier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.functions import formulas as f
from inkmark.functions.formulas import KEYS, RGB, level


def others(pixels: DataFrame) -> list[str]:
    """The keys, and columns beside the levels, which row-local distortions carry along."""
    return [c for c in pixels.columns if c not in RGB]


def _each(pixels: DataFrame, formula) -> DataFrame:
    return pixels.select(*others(pixels), *[F.expr(formula(c)).alias(c) for c in RGB])


def lossless(pixels: DataFrame) -> DataFrame:
    """The control arm: nothing changes."""
    return pixels.select(*others(pixels), *RGB)


def bit_depth(pixels: DataFrame, bits: int = 4) -> DataFrame:
    if not 1 <= bits <= 8:
        raise ValueError(f"bits must be 1 to 8, not {bits}")
    return _each(pixels, lambda c: level(f"shiftright({c}, {8 - bits}) * 255e0 / {2**bits - 1}e0"))


def gamma_table(gamma: float) -> list[int]:
    if gamma <= 0:
        raise ValueError(f"gamma must be over zero, not {gamma}")
    return [round(255 * (v / 255) ** gamma) for v in range(256)]


def gamma(pixels: DataFrame, gamma: float = 1.5) -> DataFrame:
    """Through a table of 256 levels, folded into a literal: no power a pixel."""
    lut = F.array(*[F.lit(v) for v in gamma_table(gamma)])
    return pixels.select(*others(pixels), *[F.get(lut, F.col(c)).alias(c) for c in RGB])


def gamma_by_join(pixels: DataFrame, gamma: float = 1.5) -> DataFrame:
    """The same table as rows: 256 of them, so broadcast."""
    levels = pixels.sparkSession.range(256).select(F.col("id").cast("int").alias("level"), F.expr(level(f"255e0 * pow(id / 255e0, {float(gamma)}e0)")).alias("to"))
    for c in RGB:
        pixels = pixels.join(F.broadcast(levels), F.col(c) == F.col("level")).drop("level", c).withColumnRenamed("to", c)
    return pixels.select(*KEYS, *RGB)


def grayscale(pixels: DataFrame) -> DataFrame:
    return _each(pixels, lambda c: level(f.luma()))


def bayer(size: int) -> list[int]:
    """The threshold matrix, row by row: doubled from one cell, in blocks, until it has the size."""
    n = 1 << (size - 1).bit_length()
    block = ((0, 2), (3, 1))  # fixed values: the smallest threshold matrix

    def at(y: int, x: int, n: int) -> int:
        half = n // 2
        return 4 * at(y % half, x % half, half) + block[y // half][x // half] if n > 1 else 0

    return [at(y, x, n) for y in range(n) for x in range(n)]


def dither(pixels: DataFrame, levels: int = 2, matrix_size: int = 4) -> DataFrame:
    """Ordered dithering; a size that isn't a power of two is rounded up."""
    if levels < 2 or matrix_size < 2:
        raise ValueError("levels and matrix_size must be 2 at least")
    m = bayer(matrix_size)
    n, step = int(len(m) ** 0.5), 255 / (levels - 1)
    grid = F.array(*[F.lit(v / len(m)) for v in m])
    threshold = F.get(grid, (F.col("y") % n) * n + F.col("x") % n)

    def one(c: str) -> Column:
        value = F.floor(F.col(c) / step + threshold) * step
        return F.bround(F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(255.0)), 0).cast("int").alias(c)

    return pixels.select(*others(pixels), *[one(c) for c in RGB])


def _mean_luma(pixels: DataFrame) -> DataFrame:
    """(carrier_id, mean): from a sum of integers, the same in any order."""
    total = F.sum(F.expr("cast(299 * r + 587 * g + 114 * b as bigint)"))
    return pixels.groupBy("carrier_id").agg((total / F.count("*") / 1000.0).alias("mean"))


def brightness_contrast(pixels: DataFrame, brightness: float = 1.2, contrast: float = 1.2) -> DataFrame:
    """Scaled about black, then about the carrier's mean luma."""
    lit = _each(pixels, lambda c: level(f"{c} * {float(brightness)}e0"))
    joined = lit.join(_mean_luma(lit), "carrier_id")
    return joined.select(*others(pixels), *[F.expr(level(f"mean + {float(contrast)}e0 * ({c} - mean)")).alias(c) for c in RGB])


def color_jitter(pixels: DataFrame, brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2, hue: float = 0.05, seed: int = 0) -> DataFrame:
    """Brightness, contrast, saturation and hue by four draws a carrier, in that order."""
    key = "concat_ws(':', '{seed}', cast(carrier_id as string), '{k}')"

    def draw(k: int, width: float) -> str:
        return f"((2e0 * {f.uniform(key.format(seed=seed, k=k))} - 1e0) * {float(width)}e0)"

    lit = _each(pixels, lambda c: level(f"{c} * (1e0 + {draw(0, brightness)})"))
    joined = lit.join(_mean_luma(lit), "carrier_id")
    own = others(pixels)
    flat = joined.select(*own, *[F.expr(level(f"mean + (1e0 + {draw(1, contrast)}) * ({c} - mean)")).alias(c) for c in RGB])
    grey = flat.withColumn("grey", F.expr(level(f.luma())))
    full = grey.select(*own, *[F.expr(level(f"grey + (1e0 + {draw(2, saturation)}) * ({c} - grey)")).alias(c) for c in RGB])
    hsv = full.select(*own, *[F.expr(e).alias(n) for n, e in f.to_hsv().items()])
    hsv = hsv.withColumn("h", F.expr(f"pmod(h + cast({draw(3, hue)} * 255e0 as int), 256)"))
    return hsv.select(*own, *[F.expr(e).alias(c) for c, e in f.from_hsv("h", "s", "v").items()])


#: Per space: the way there, its columns, the way back.
SPACES = {
    "YCbCr": (f.to_ycbcr, ("y_", "cb", "cr"), f.from_ycbcr),
    "HSV": (f.to_hsv, ("h", "s", "v"), f.from_hsv),
    "LAB": (f.to_lab, ("l", "a", "b_"), f.from_lab),
}


def color_noise(pixels: DataFrame, space: str = "YCbCr", noise_std: float = 10.0, seed: int = 0) -> DataFrame:
    """Normal noise in a colour space, from a hash of the pixel's place: the same in any partitioning."""
    if space not in SPACES:
        raise ValueError(f"unknown space {space}")
    to, names, back = SPACES[space]

    def normal(c: str) -> str:
        u = [f.uniform(f"concat_ws(':', '{seed}', cast(carrier_id as string), cast(y as string), cast(x as string), '{c}{k}')") for k in (0, 1)]
        return f"(sqrt(-2e0 * ln(1e0 - {u[0]})) * cos(6.283185307179586e0 * {u[1]}))"

    kept = others(pixels)
    own = pixels.select(*kept, *[F.expr(e).alias(n) for n, e in to().items()])
    noisy = own.select(*kept, *[F.expr(level(f"{n} + {float(noise_std)}e0 * {normal(n)}")).alias(n) for n in names])
    return noisy.select(*kept, *[F.expr(e).alias(c) for c, e in back(*names).items()])
