"""Numbers and sums along an order within groups, without bringing a group together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.sources.scratch import stored


def running(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same `by` that come before, in the given order.

    Rows are dealt out by ranges of (by, order), summed up within a range, and moved by what lies in the ranges before:
    a group as large as the table is spread over all ranges. The windows over ranges have a row for each group and
    range. Rows that are equal in (by, order) lie in one range; their order among each other is any.
    """
    ranged = stored(rows.withColumn("__value", value).repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = F.coalesce(F.sum("__value").over(Window.partitionBy("__range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy(by, "__range").agg(F.sum("__value").alias("__total"))
    moved = F.coalesce(F.sum("__total").over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col(by).alias("__by"), F.col("__range").alias("__at"), moved.alias("__moved"))
    joined = ranged.withColumn("__within", within).join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__at")))
    return joined.select(*rows.columns, (F.col("__within") + F.col("__moved")).alias(name))
