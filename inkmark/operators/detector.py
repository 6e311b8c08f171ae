"""Quality of detectors: confusion counts, ranks, area under the curve, p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.operators.ordered import running

def unmatched_labels(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sample_id, side): the samples that one side lacks."""
    a, b = truth.select("sample_id").distinct(), predicted.select("sample_id").distinct()
    return a.join(b, "sample_id", "left_anti").withColumn("side", F.lit("no_prediction")).unionByName(b.join(a, "sample_id", "left_anti").withColumn("side", F.lit("no_truth")))


def confusion_counts(detections: DataFrame) -> DataFrame:
    """(detector_id, tp, tn, fp, fn); positive is exactly 1."""
    t, p = F.coalesce(F.col("y_true") == 1, F.lit(False)), F.coalesce(F.col("y_pred") == 1, F.lit(False))
    return detections.groupBy("detector_id").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores(detections: DataFrame) -> DataFrame:
    """confusion_counts with accuracy, precision, recall and f1; a share of nothing is 0."""
    c = confusion_counts(detections)
    tp, tn, fp, fn = (F.col(n) for n in ("tp", "tn", "fp", "fn"))
    c = c.withColumns({"accuracy": _share(tp + tn, tp + tn + fp + fn), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", _share(2 * p * r, p + r))


def avg_ranks(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows with rank: ascending from 1 within `by`, ties averaged.

    Values are counted first, and the counts summed up by ranges: no task holds all rows, or values, of a `by`.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("__n"))
    ranks = running(counts, by, [value], F.col("__n"), "__below")
    ranks = ranks.select(F.col(by).alias("__by"), F.col(value).alias("__at"), (F.col("__below") + (F.col("__n") + 1) / 2).alias("rank"))
    return rows.join(ranks, F.col(by).eqNullSafe(F.col("__by")) & F.col(value).eqNullSafe(F.col("__at"))).drop("__by", "__at")


def auc(detections: DataFrame) -> DataFrame:
    """(detector_id, auc): the share of pairs in which the positive scores higher, ties as half; NaN without a pair.

    Counted by distinct score first, and the counts summed up by ranges of scores.
    """
    by = detections.groupBy("detector_id", "y_score").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    summed = running(by, "detector_id", ["y_score"], F.col("neg"), "below")
    won = summed.select("detector_id", "pos", "neg", (F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("won"))
    total = won.groupBy("detector_id").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("won").alias("won"))
    return total.select("detector_id", F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(float("nan"))).otherwise(F.col("won") / (2 * F.col("p") * F.col("n"))).alias("auc"))


def p_value(statistics: DataFrame, null_samples: DataFrame, by: str | None = None) -> DataFrame:
    """statistics(..., value) with p_value = (#{null >= value} + 1) / (n + 1) against the null values of the same `by`
    (all of them without it); NaN with an empty null sample, null for a null value.

    A range join by (by, value): null values and statistics are counted by value together, and the counts summed up by
    ranges, as many as the shuffle has partitions. No pair is formed and no task holds a whole sample.
    """
    own = F.col(by) if by else F.lit(0)
    null_ = null_samples.where("value is not null").select(own.alias("__group"), "value", F.lit(1).alias("n"), F.lit(False).alias("asked"))
    ask = statistics.where("value is not null").select(own.alias("__group"), "value", F.lit(0).alias("n"), F.lit(True).alias("asked"))
    counts = null_.unionByName(ask).groupBy("__group", "value").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    below = running(counts, "__group", ["value"], F.col("n"), "below").where("asked").select("__group", F.col("value").alias("__at"), "below")
    total = null_.groupBy("__group").agg(F.count("*").alias("__n")).withColumnRenamed("__group", "__of")
    named = statistics.withColumn("__own", own)
    placed = named.join(below, F.col("__own").eqNullSafe(F.col("__group")) & (F.col("value") == F.col("__at")), "left").join(total, F.col("__own").eqNullSafe(F.col("__of")), "left")
    n = F.coalesce(F.col("__n"), F.lit(0))
    p = F.when(F.col("value").isNull(), F.lit(None).cast("double")).when(n == 0, F.lit(float("nan"))).otherwise((n - F.col("below") + 1) / (n + 1))
    return placed.select(*statistics.columns, p.alias("p_value"))
