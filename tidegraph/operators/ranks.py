"""Places over all rows without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import persisted


def global_rank(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place from 0 in the given order (ties in any order).

    Rows are range partitioned and written with the number of their range; ranks inside a range then start
    from a running sum over one count a range, the only thing that is broadcast.
    """
    placed = persisted(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")
