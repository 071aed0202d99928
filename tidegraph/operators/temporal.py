"""Point-in-time reads over append-only versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ("src", "edge_type", "dst")


def newest(versions: DataFrame, keys: Sequence[str], at: int | Column | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """The newest version of each key at or before ``at``, tombstones included; of equal times the last written,
    of those the first by ``ties``, without which reruns may differ."""
    if at is not None:
        versions = versions.where(F.col("ts") <= at)
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq").desc(), *ties)
    return versions.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def newest_by_max(versions: DataFrame, keys: Sequence[str], at: int | None = None) -> DataFrame:
    """The same by an aggregate, which combines before the shuffle; better for deep histories."""
    if at is not None:
        versions = versions.where(F.col("ts") <= at)
    rest = [c for c in versions.columns if c not in {*keys, "ts", "seq"}]
    return versions.groupBy(*keys).agg(F.max(F.struct("ts", "seq", *rest)).alias("_v")).select(*keys, "_v.*")


def as_of(versions: DataFrame, keys: Sequence[str], at: int | Column, ties: Sequence[Column] = ()) -> DataFrame:
    """Live state: the newest version first, then tombstones go."""
    return newest(versions, keys, at, ties).where(~F.col("deleted"))


def as_of_batch(versions: DataFrame, keys: Sequence[str], requests: DataFrame, time: str = "t") -> DataFrame:
    """For each request (keys and a time) the newest version at or before its time, left null where none is.

    Requests and versions are merged in one ordered pass per key, so work is linear in both.
    """
    rest = [c for c in versions.columns if c not in keys]
    extra = [c for c in requests.columns if c not in {*keys, time}]
    v = versions.select(*keys, F.col("ts").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").alias("_seq"), F.struct(*rest).alias("_v"), *[F.lit(None).cast(requests.schema[c].dataType).alias(f"_q_{c}") for c in extra])
    q = requests.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_q_{c}") for c in extra])
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = v.unionByName(q).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return merged.select(*keys, F.col("_at").alias(time), *[F.col(f"_q_{c}").alias(c) for c in extra], "_v.*")


def versions_between(versions: DataFrame, low: int, high: int) -> DataFrame:
    """Every version in the closed window, tombstones included; empty if the bounds are crossed."""
    return versions.where(F.col("ts").between(low, high))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges seen from an anchor: out, in or both; ``anchor`` and ``other`` are added."""
    out = edges.withColumns({"anchor": F.col("src"), "other": F.col("dst"), "outgoing": F.lit(True)})
    into = edges.withColumns({"anchor": F.col("dst"), "other": F.col("src"), "outgoing": F.lit(False)})
    return {"out": out, "in": into}[direction] if direction != "both" else out.unionByName(into)


def adjacency_limited(live: DataFrame, limit: int, by_type: bool = True, direction: str = "out") -> DataFrame:
    """The newest ``limit`` live edges of each anchor and type, or over all types in the order (type, newest, other)."""
    keys = ("anchor", "edge_type") if by_type else ("anchor",)
    order = [F.col("ts").desc(), F.col("other")] if by_type else [F.col("edge_type"), F.col("ts").desc(), F.col("other")]
    o = oriented(live, direction)
    return o.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= limit).drop("_rank")


def tombstones(edges: DataFrame, ts: Column, seq: Column) -> DataFrame:
    """Removal versions for the given edges: no properties."""
    out = edges.withColumns({"ts": ts, "seq": seq, "deleted": F.lit(True)})
    return out.withColumn("properties", F.lit(None).cast("string")) if "properties" in edges.columns else out


def last_write_wins(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key and time: the one with the largest sequence number."""
    w = Window.partitionBy(*keys, "ts").orderBy(F.col("seq").desc())
    return versions.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
