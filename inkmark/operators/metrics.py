"""Metrics of pixels and of bit strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB, luma
from inkmark.operators.embed import BINARY
from inkmark.operators.tiles import Mergeable, user_metrics


def paired_pixels(first: DataFrame, second: DataFrame) -> DataFrame:
    """(keys, dr, dg, db): differences by place; a place on one side only is an error."""
    a = first.select(*KEYS, *RGB)
    b = second.select(*KEYS, *[F.col(c).alias(f"d{c}") for c in RGB])
    joined = a.join(b, list(KEYS), "full_outer")
    lacks = F.col("r").isNull() | F.col("dr").isNull()
    return joined.select(*KEYS, *[F.when(lacks, F.raise_error(F.lit("frames differ in size")).cast("int")).otherwise(F.col(c) - F.col(f"d{c}")).alias(f"d{c}") for c in RGB])


def psnr_of(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / mse))


def mse(first: DataFrame, second: DataFrame) -> DataFrame:
    """(carrier_id, mse): over pixels and channels, from sums of integers."""
    square = F.sum(F.expr("cast(dr * dr + dg * dg + db * db as bigint)"))
    return paired_pixels(first, second).groupBy("carrier_id").agg((square / (3 * F.count("*"))).alias("mse"))


def psnr(first: DataFrame, second: DataFrame) -> DataFrame:
    """(carrier_id, psnr): infinite where nothing differs."""
    return mse(first, second).select("carrier_id", psnr_of(F.col("mse")).alias("psnr"))


def watermark_psnr(first: DataFrame, second: DataFrame) -> DataFrame:
    """(carrier_id, psnr) of the lumas, over the places that both have."""
    a, b = first.select(*KEYS, F.expr(luma()).alias("a")), second.select(*KEYS, F.expr(luma()).alias("b"))
    joined = a.join(b, list(KEYS)).groupBy("carrier_id").agg(F.avg(F.expr("(a - b) * (a - b)")).alias("mse"))
    return joined.select("carrier_id", psnr_of(F.col("mse")).alias("psnr"))


def bit_length_mismatch(pairs: DataFrame) -> DataFrame:
    """The pairs(original, extracted) of bit strings whose lengths differ, and both lengths."""
    n, m = F.length("original"), F.length("extracted")
    return pairs.where(n != m).withColumns({"n_original": n, "n_extracted": m}).drop("original", "extracted")


def compared_bits(pairs: DataFrame, allow_length_mismatch: bool = False) -> DataFrame:
    """pairs with n (bits compared), wrong (of them) and status: ok, empty, length_mismatch or not_binary.

    Only what is compared is checked: the common prefix where lengths may differ. n and wrong are null unless ok, so
    a short extraction never looks like an honest score.
    """
    n = F.least(F.length("original"), F.length("extracted"))
    a, b = F.left("original", n), F.left("extracted", n)
    status = F.when(F.col("original").isNull() | F.col("extracted").isNull(), "empty")
    status = status.when((F.length("original") != F.length("extracted")) & F.lit(not allow_length_mismatch), "length_mismatch")
    status = status.when(n == 0, "empty").when(~a.rlike(BINARY) | ~b.rlike(BINARY), "not_binary").otherwise("ok")
    wrong = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return pairs.withColumn("status", status).withColumn("n", F.when(F.col("status") == "ok", n)).withColumn("wrong", F.when(F.col("status") == "ok", wrong))


def ber(pairs: DataFrame, allow_length_mismatch: bool = False) -> DataFrame:
    """pairs(..., original, extracted) with ber instead of the strings, and status."""
    found = compared_bits(pairs, allow_length_mismatch)
    return found.withColumn("ber", F.col("wrong") / F.col("n")).drop("original", "extracted", "n", "wrong")


def nc(pairs: DataFrame, allow_length_mismatch: bool = False) -> DataFrame:
    """The same with nc: of bits as -1 and 1, the sum of products over the root of the sums of squares."""
    found = compared_bits(pairs, allow_length_mismatch)
    return found.withColumn("nc", (F.col("n") - 2 * F.col("wrong")) / F.col("n")).drop("original", "extracted", "n", "wrong")


def strict(scored: DataFrame, metric: str) -> DataFrame:
    """A metric of the report form as one that fails at the first pair that isn't ok."""
    return scored.withColumn(metric, F.when(F.col("status") == "ok", F.col(metric)).otherwise(F.raise_error(F.col("status")).cast("double"))).drop("status")


def metric_suite(first: DataFrame, second: DataFrame, own: dict[str, Mergeable] | None = None) -> DataFrame:
    """(carrier_id, metric, value): what one pass over the paired pixels gives, as rows, and a user's own metrics."""
    d = paired_pixels(first, second)
    square, most = F.sum(F.expr("cast(dr * dr + dg * dg + db * db as bigint)")), F.max(F.greatest(*[F.abs(f"d{c}") for c in RGB]))
    both = d.groupBy("carrier_id").agg((square / (3 * F.count("*"))).alias("mse"), most.cast("double").alias("max_difference"), F.avg(F.expr("case when dr <> 0 or dg <> 0 or db <> 0 then 1e0 else 0e0 end")).alias("changed"))
    both = both.withColumn("psnr", psnr_of(F.col("mse")))
    built_in = both.select("carrier_id", F.expr("stack(4, 'mse', mse, 'psnr', psnr, 'max_difference', max_difference, 'changed', changed) as (metric, value)"))
    return built_in.unionByName(user_metrics(first, second, own)) if own else built_in


def lossless_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows that one side has and the other hasn't, tagged; none if they are equal."""
    a, b = first.select(*KEYS, *RGB), second.select(*KEYS, *RGB)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
