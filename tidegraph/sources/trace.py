"""Mutation traces (JSON lines), encounter files, bulk loads and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE_TYPES, TRACE, InvalidRequest, require_edge_type

OPS = ("upsert_node", "add_edge", "remove_edge")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A trace in file order; blank lines are skipped, malformed lines and unknown operations raise, as does an empty trace."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq")).where(F.trim("value") != "")
    parsed = lines.select("file", "seq", F.from_json("value", TRACE, {"mode": "FAILFAST"}).alias("r")).select("seq", "r.*")
    bad = F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))).cast("string")
    out = parsed.withColumn("op", F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(bad))
    out = out.withColumn("edge_type", F.when(F.col("op") != "upsert_node", require_edge_type(F.col("edge_type"))))
    if out.isEmpty():
        raise InvalidRequest("the trace is empty")
    return out


def trace_nodes(trace: DataFrame) -> DataFrame:
    return trace.where("op = 'upsert_node'").select("node_id", F.col("timestamp_us").alias("ts"), "seq", "node_type", F.coalesce("properties", F.lit("{}")).alias("properties"), F.lit(False).alias("deleted"))


def trace_edges(trace: DataFrame) -> DataFrame:
    """Added edges as versions, removed ones as tombstones without properties."""
    gone = F.col("op") == "remove_edge"
    return trace.where("op <> 'upsert_node'").select("src", "edge_type", "dst", F.col("timestamp_us").alias("ts"), "seq", F.when(~gone, F.coalesce("properties", F.lit("{}"))).alias("properties"), gone.alias("deleted"))


def bulk_load(versions: DataFrame, path: str, key: str, files: int | None = None) -> DataFrame:
    """Append versions clustered by key and time, so that later reads prune row groups; returns what was stored."""
    ranged = versions.repartitionByRange(files, key, "ts") if files else versions.repartitionByRange(key, "ts")
    ranged.sortWithinPartitions(key, "ts").write.mode("append").parquet(path)
    return versions.sparkSession.read.parquet(path)


def manifest(trace: DataFrame) -> DataFrame:
    """One row: counts by operation and an order-free digest of the lines."""
    n = lambda op: F.count_if(F.col("op") == op).alias(f"{op}s")
    line = F.sha2(F.to_json(F.struct(*sorted(trace.columns))), 256)
    return trace.agg(*map(n, OPS), F.count(F.lit(1)).alias("records"), F.bit_xor(F.conv(F.substring(line, 1, 15), 16, 10).cast("long")).alias("digest"))


ENCOUNTER_COLUMNS = ("encounter_id", "patient_nbr", "diag_1", "diag_2", "diag_3", "medical_specialty", "max_glu_serum", "A1Cresult", "readmitted")


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    """Encounter rows of a CSV file with a header; missing columns raise."""
    rows = spark.read.option("header", True).csv(path)
    lost = [c for c in ENCOUNTER_COLUMNS if c not in rows.columns]
    if lost:
        raise InvalidRequest(f"missing columns {lost}")
    return rows.withColumn("encounter_id", F.col("encounter_id").cast("long"))


__all__ = ["EDGE_TYPES", "bulk_load", "manifest", "read_encounters", "read_trace", "trace_edges", "trace_nodes"]
