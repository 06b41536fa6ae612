"""Accuracy of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: Column, p: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    e = p - y
    mse = F.avg(e * e)
    return df.groupBy(*keys).agg(F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"))


def classification_metrics(df: DataFrame, y: Column, p: Column, clip: float = 1e-15) -> DataFrame:
    """Accuracy at 0.5 and mean log loss of a probability of class 1."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return df.agg(F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"), (-F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"))


def auc(df: DataFrame, y: Column, p: Column, buckets: int = 4096) -> DataFrame:
    """Area under the curve by ranks, equal scores counting half.

    Rows with equal scores are summed first.  Scores are dealt into buckets of equal width; a bucket's own running sum
    starts at the total of the buckets below, so that only bucket totals meet in one task."""
    by = df.groupBy(p.cast("double").alias("p")).agg(F.sum((y == 1).cast("double")).alias("pos"), F.sum((y != 1).cast("double")).alias("neg"))
    placed = by.withColumn("bucket", F.floor(F.col("p") * buckets))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("bucket").agg(F.sum("neg").alias("all")).select(F.col("bucket").alias("__bucket"), F.coalesce(F.sum("all").over(before), F.lit(0.0)).alias("start"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = placed.join(totals, F.col("bucket") == F.col("__bucket")).withColumn("below", F.col("start") + inside)
    return ranked.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def calibration(df: DataFrame, y: Column, p: Column, bins: int = 5) -> DataFrame:
    """Expected and largest gap between confidence and frequency over equal bins."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1))
    by = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(y.cast("double"))).alias("gap"))
    return by.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
