"""Aggregates of evaluation and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve from rank sums, tied scores sharing their mean rank; by distinct score, so that the
    window runs over scores and not rows."""
    by = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    s = by.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Mean precision at the positives, ordered by falling score and then ``tie``."""
    w = Window.orderBy(F.col(score).desc(), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.col(label).cast("long")
    ranked = rows.select(hit.alias("y"), (F.sum(hit).over(w) / F.count(F.lit(1)).over(w)).alias("precision"))
    return ranked.agg(F.round(F.sum(F.col("y") * F.col("precision")) / F.sum("y"), 6).alias("average_precision"))


def latency_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Nearest-rank percentiles with least, largest and mean value."""
    p = lambda q, n: F.expr(f"percentile_disc({q}) within group (order by {value})").alias(n)
    return rows.groupBy(by).agg(p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.min(value).alias("least"), F.max(value).alias("largest"), F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def standardised(rows: DataFrame, value: str) -> DataFrame:
    s = rows.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.crossJoin(F.broadcast(s)).withColumn("z", F.round((F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6), 6)).drop("_m", "_s")


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def upper_median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Element number n / 2 of the sorted values."""
    w = Window.partitionBy(by)
    ranked = rows.withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(by, F.col(value).alias("median"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Linear interpolation in the bucket where the cumulative count reaches ``q``; rows (le, n), ordered by le."""
    w = Window.orderBy("le")
    c = buckets.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.sum("n").over(Window.partitionBy())})
    c = c.where(F.col("upto") >= F.col("total") * q).orderBy("le").limit(1)
    return c.select(F.round(F.col("low") + (F.col("le") - F.col("low")) * (F.col("total") * q - (F.col("upto") - F.col("n"))) / F.col("n"), 6).alias("quantile"))
