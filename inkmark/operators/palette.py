"""Palette reduction: k-means on a sample, and median cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB, level
from inkmark.operators.ordered import running
from inkmark.operators.point import others
from inkmark.sources.scratch import stored

#: Parts of a carrier in which its sample is chosen first.
PARTS = 64


def pixel_sample(pixels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n pixels of a carrier with the least hash of their place, and their rank from 1.

    First of each of PARTS parts of a carrier, then of what those leave: n * PARTS rows at most meet in a task.
    """
    h = F.expr(f"md5(concat_ws(':', '{seed}', cast(carrier_id as string), cast(y as string), cast(x as string)))")
    hashed = pixels.select(*KEYS, *RGB, h.alias("h"), F.pmod(F.xxhash64("y", "x"), F.lit(PARTS)).alias("part"))
    first = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("carrier_id", "part").orderBy("h", "y", "x"))).where(F.col("rank") <= n)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("carrier_id").orderBy("h", "y", "x")))
    return ranked.where(F.col("rank") <= n).select(*KEYS, *RGB, "rank")


def _nearest(colors: int) -> str:
    """Index of the first nearest of the centres in arrays cr, cg, cb, without a row a centre."""
    square = " + ".join(f"({c} - c{c}[i]) * ({c} - c{c}[i])" for c in RGB)
    return f"array_min(transform(sequence(0, {colors - 1}), i -> struct({square} as d, i))).i"


def kmeans_palette(pixels: DataFrame, colors: int = 16, sample_size: int = 5000, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(carrier_id, cr, cg, cb): arrays of the centres after the rounds; an empty cluster keeps its centre."""
    if colors < 2 or colors > sample_size:
        raise ValueError("colors must be 2 at least, and not over sample_size")
    sample = stored(pixel_sample(pixels, sample_size, seed), "sample")  # the rounds read this alone

    def arrays(rows: DataFrame) -> DataFrame:  # `colors` entries a carrier
        return rows.groupBy("carrier_id").agg(F.array_sort(F.collect_list(F.struct("k", *RGB))).alias("all")).select("carrier_id", *[F.col(f"all.{c}").alias(f"c{c}") for c in RGB])

    centres = arrays(sample.where(F.col("rank") <= colors).select("carrier_id", (F.col("rank") - 1).alias("k"), *[F.col(c).cast("double").alias(c) for c in RGB]))
    for _ in range(iterations):
        found = sample.join(centres, "carrier_id").withColumn("k", F.expr(_nearest(colors)))
        means = found.groupBy("carrier_id", "k").agg(*[(F.sum(c) / F.count("*")).alias(c) for c in RGB])
        old = centres.select("carrier_id", F.posexplode(F.arrays_zip(*[f"c{c}" for c in RGB])).alias("k", "p"))
        both = old.join(means, ["carrier_id", "k"], "left").select("carrier_id", "k", *[F.coalesce(F.col(c), F.col(f"p.c{c}")).alias(c) for c in RGB])
        centres = stored(arrays(both), "centres")  # `colors` numbers a carrier; each round reads the last one's
    return centres


def quantize_kmeans(pixels: DataFrame, colors: int = 16, sample_size: int = 5000, iterations: int = 10, seed: int = 0) -> DataFrame:
    """Every pixel becomes the nearest centre; the palette is learned on a sample of its carrier."""
    centres = kmeans_palette(pixels, colors, sample_size, iterations, seed)
    found = pixels.join(centres, "carrier_id").withColumn("k", F.expr(_nearest(colors)))
    return found.select(*others(pixels), *[F.expr(level(f"c{c}[k]")).alias(c) for c in RGB])


def quantize_median_cut(pixels: DataFrame, colors: int = 16) -> DataFrame:
    """log2(colors) rounds: each box is halved at the median of its widest channel; a box becomes its mean.

    Boxes are halved by colours counted once, in running sums by ranges of (box, channel, colour): no task holds all
    colours of a box.
    """
    if colors < 2 or colors & (colors - 1):
        raise ValueError("colors must be a power of two, 2 at least")
    own = pixels.groupBy("carrier_id", *RGB).agg(F.count("*").alias("n")).withColumn("box", F.lit(0))
    for _ in range(colors.bit_length() - 1):
        boxes = own.groupBy("carrier_id", "box").agg(*[(F.max(c) - F.min(c)).alias(f"w{c}") for c in RGB], F.sum("n").alias("all"))
        key = F.expr("case when wr >= wg and wr >= wb then r when wg >= wb then g else b end")
        placed = own.join(boxes, ["carrier_id", "box"]).withColumn("key", key).withColumn("of", F.struct("carrier_id", "box"))
        summed = running(placed.select("of", "key", *RGB, "n", "all"), "of", ["key", *RGB], F.col("n"), "before")
        own = summed.select("of.carrier_id", *RGB, "n", F.expr("of.box * 2 + case when 2 * before >= all then 1 else 0 end").alias("box"))
    means = own.groupBy("carrier_id", "box").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{c}") for c in RGB])
    table = own.join(means, ["carrier_id", "box"]).select("carrier_id", *RGB, *[F.expr(level(f"m{c}")).alias(f"q{c}") for c in RGB])
    return pixels.join(table, ["carrier_id", *RGB]).select(*others(pixels), *[F.col(f"q{c}").alias(c) for c in RGB])


def palette_size(pixels: DataFrame) -> DataFrame:
    """(carrier_id, n_colors)."""
    return pixels.groupBy("carrier_id").agg(F.countDistinct(*RGB).alias("n_colors"))


def color_sketches(pixels: DataFrame, *tags: str, precision: int = 12) -> DataFrame:
    """(carrier_id, tags..., sketch): HyperLogLog states of the colours, a few kilobytes each, which merge without the pixels."""
    color = (F.col("r") * 256 + F.col("g")) * 256 + F.col("b")
    return pixels.groupBy("carrier_id", *tags).agg(F.hll_sketch_agg(color, precision).alias("sketch"))


def merged_colors(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., n_colors): about as many distinct colours as the sketches of a group hold together, over all groups
    without `by`; the standard error is 1.04 / sqrt(2 ** precision), 1.6 % of the number for 12."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_colors"))
