"""Embed, distort, extract, score: many carriers by many distortions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB
from inkmark.operators import crop, dct, embed, histogram, metrics, palette, point
from inkmark.sources.carriers import sizes
from inkmark.sources.scratch import stored

Attack = Callable[[DataFrame], DataFrame]

#: A few distortions, one or two of each category: id -> (category, distortion).
BASIC: dict[str, tuple[str, Attack]] = {
    "lossless": ("compression", point.lossless),
    "bit_depth": ("color", point.bit_depth),
    "gamma": ("color", point.gamma),
    "crop_pad": ("geometric", crop.crop_pad),
}

#: All registered distortions with their default parameters.
ATTACKS: dict[str, tuple[str, Attack]] = BASIC | {
    "block_dct": ("compression", dct.block_dct),
    "brightness_contrast": ("color", point.brightness_contrast),
    "color_jitter": ("color", point.color_jitter),
    "color_noise": ("color", point.color_noise),
    "grayscale": ("color", point.grayscale),
    "hist_equalize": ("color", histogram.hist_equalize),
    "clahe": ("color", histogram.clahe),
    "quantize_kmeans": ("color", palette.quantize_kmeans),
    "quantize_median_cut": ("color", palette.quantize_median_cut),
    "dither": ("color", point.dither),
    "crop_resize": ("geometric", crop.crop_resize),
}

#: Distortions that keep a pixel's place and are scored in one job.
AT_ONCE = 3


def attack_suite(pixels: DataFrame, attacks: dict[str, tuple[str, Attack]] | None = None) -> DataFrame:
    """The pixels after each distortion, tagged by category and attack_id. Any DataFrame -> DataFrame will do."""
    done = [attack(pixels).withColumns({"category": F.lit(category), "attack_id": F.lit(name)}) for name, (category, attack) in (attacks or BASIC).items()]
    return reduce(DataFrame.unionByName, done)


def attack_chain(pixels: DataFrame, *attacks: Attack) -> DataFrame:
    return reduce(DataFrame.transform, attacks, pixels)


def param_sweep(pixels: DataFrame, attack: Callable[[DataFrame, float], DataFrame], values: list[float]) -> DataFrame:
    """One distortion at each of a list of strengths, tagged by param."""
    return reduce(DataFrame.unionByName, [attack(pixels, v).withColumn("param", F.lit(float(v))) for v in values])


def lut_sweep(pixels: DataFrame, table: Callable[[float], list[int]], values: list[float]) -> DataFrame:
    """Distortions by a table of 256 levels at each of a list of strengths, tagged by param: pixels are read once, and
    a row becomes one for each strength."""
    each = [F.struct(F.lit(float(v)).alias("param"), F.array(*[F.lit(int(to)) for to in table(v)]).alias("to")) for v in values]
    rows = pixels.select(*KEYS, *RGB, F.explode(F.array(*each)).alias("__of"))
    return rows.select(*KEYS, *[F.get(F.col("__of.to"), F.col(c)).alias(c) for c in RGB], F.col("__of.param").alias("param"))


def custom_attack(pixels: DataFrame, frame_function: Callable, schema: str = "carrier_id long, y int, x int, r int, g int, b int") -> DataFrame:
    """A pandas function of one carrier's pixels, for what columns can't express; a carrier must fit into a task."""
    return pixels.groupBy("carrier_id").applyInPandas(frame_function, schema)


def robustness(pixels: DataFrame, marks: DataFrame, num_bits: int, attacks: dict[str, tuple[str, Attack]] | None = None) -> DataFrame:
    """(category, attack_id, carrier_id, ber, nc, psnr, status) of every distortion of every marked carrier.

    The marked pixels are stored once and carry their own levels and place along. A distortion that keeps them, as
    row-local ones do, needs no join: all of these are scored by one aggregate. The others are joined by place.
    Each of the others, and each few of the former, is a job of its own that leaves a row for each carrier: the driver
    never holds a plan of more than a few distortions, nor does the last one.
    """
    marked = embed.embed_pixels(pixels, marks)
    placed = marked.join(sizes(marked), "carrier_id").select(*KEYS, *RGB, F.expr("(cast(y as bigint) * width + x) * 3").alias("at"), *[F.col(c).alias(f"old_{c}") for c in RGB])
    placed = stored(placed, "marked")
    plain, kept, found = placed.select(*KEYS, *RGB), [], []
    for name, (category, attack) in (attacks or ATTACKS).items():
        tags = {"category": F.lit(category), "attack_id": F.lit(name)}
        hit = attack(placed)
        if "old_r" in hit.columns:
            kept.append(hit.select(*placed.columns).withColumns(tags))
        else:
            hit = attack(plain)
            both = embed.extract_pixels(hit, num_bits).join(metrics.mse(plain, hit), "carrier_id")
            found.append(stored(both.withColumns(tags), "scored"))
    for i in range(0, len(kept), AT_ONCE):
        each = reduce(DataFrame.unionByName, kept[i : i + AT_ONCE])
        square = F.sum(F.expr(" + ".join(f"cast(({c} - old_{c}) * ({c} - old_{c}) as bigint)" for c in RGB)))
        low = F.concat(*[F.col(c).bitwiseAND(F.lit(1)).cast("string") for c in RGB])
        bits = F.array_sort(F.collect_list(F.when(F.col("at") < num_bits, F.struct("at", low.alias("bit")))))  # num_bits at most
        scored = each.groupBy("category", "attack_id", "carrier_id").agg((square / (3 * F.count("*"))).alias("mse"), bits.alias("all"))
        own = scored.select("category", "attack_id", "carrier_id", "mse", F.left(F.array_join("all.bit", ""), F.lit(num_bits)).alias("bits"))
        found.append(stored(own, "scored"))
    rows = reduce(DataFrame.unionByName, found).withColumnRenamed("bits", "extracted")
    pairs = metrics.compared_bits(marks.select("carrier_id", F.left("bits", F.lit(num_bits)).alias("original")).join(rows, "carrier_id"))
    wrong, n = F.col("wrong"), F.col("n")
    return pairs.select("category", "attack_id", "carrier_id", (wrong / n).alias("ber"), ((n - 2 * wrong) / n).alias("nc"), metrics.psnr_of(F.col("mse")).alias("psnr"), "status")


def suite_report(scored: DataFrame) -> DataFrame:
    """Means by category and distortion, by category, and over all; infinite psnr counts apart, as unchanged."""
    finite = F.when(F.col("psnr") < float("inf"), F.col("psnr"))
    grouped = scored.rollup("category", "attack_id").agg(F.round(F.avg("ber"), 6).alias("ber"), F.round(F.avg("nc"), 6).alias("nc"), F.round(F.avg(finite), 6).alias("psnr"), F.count_if(F.col("psnr") == float("inf")).alias("n_unchanged"), F.count("*").alias("n"))
    return grouped
