"""The star-schema tables seen as versioned nodes, edges and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations, parts, suppliers, regions from time 0; orders from their date, finished ones end 90 days later."""
    t = lambda name, key, base, kind: table(spark, sf_dir, name).select((F.col(key).cast("long") + base).alias("node_id"), F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(kind).alias("node_type"), F.lit(False).alias("deleted"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 600_000).alias("node_id"), micros("o_orderdate").alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("Encounter").alias("node_type"), F.lit(False).alias("deleted"), "o_orderstatus")
    ended = orders.where("o_orderstatus = 'F'").select("node_id", (F.col("ts") + 90 * 86_400_000_000).alias("ts"), F.lit(1).cast("long").alias("seq"), "node_type", F.lit(True).alias("deleted"))
    out = orders.drop("o_orderstatus").unionByName(ended)
    for x in (("customer", "c_custkey", 1, "Patient"), ("nation", "n_nationkey", 100_000, "Condition"), ("part", "p_partkey", 200_000, "Medication"), ("supplier", "s_suppkey", 400_000, "Provider"), ("region", "r_regionkey", 500_000, "LabResult")):
        out = out.unionByName(t(*x))
    return out


def line_edges(spark: SparkSession, sf_dir: str, edge_type: int = 4) -> DataFrame:
    """Customer to supplier (4) or part (2) at the ship date; returned lines are tombstones."""
    key, base = ("l_suppkey", 400_000) if edge_type == 4 else ("l_partkey", 200_000)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", micros("l_shipdate").alias("ts"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    seq = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    return lines.join(owners, "l_orderkey").select((F.col("o_custkey") + 1).alias("src"), F.lit(edge_type).alias("edge_type"), (F.col(key) + base).alias("dst"), "ts", seq.alias("seq"), (F.col("l_returnflag") == "R").alias("deleted"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to order (6) at its date; to nation (1) and region (5) at the customer's first order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), micros("o_orderdate").alias("ts"))
    zero, live = F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted")
    src = (F.col("c_custkey") + 1).alias("src")
    own = orders.select(src, F.lit(6).alias("edge_type"), (F.col("o_orderkey") + 600_000).alias("dst"), "ts", zero, live)
    homes = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    first = orders.groupBy("c_custkey").agg(F.min("ts").alias("ts")).join(homes, "c_custkey")
    nation = first.select(src, F.lit(1).alias("edge_type"), (F.col("n_nationkey") + 100_000).cast("long").alias("dst"), "ts", zero, live)
    region = first.select(src, F.lit(5).alias("edge_type"), (F.col("n_regionkey") + 500_000).cast("long").alias("dst"), "ts", zero, live)
    return own.unionByName(nation).unionByName(region)


def edge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edges(spark, sf_dir, 2).unionByName(line_edges(spark, sf_dir, 4)).unionByName(order_edges(spark, sf_dir))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users to one of 20 targets with six types, many versions a key; errors are tombstones."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (1 + k % 6).alias("edge_type"), (F.lit(100_000).cast("long") + k % 20).alias("dst"), micros("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("props").alias("properties"), (F.col("event_type") == "error").alias("deleted"))


def embedding_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version at 10, a second at 20 (the next id's vector) for ids divisible by 3; those divisible by 7 start at 20."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model_id"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    shifted = e.select("node_id", "model_id").where("node_id % 3 = 0").crossJoin(F.broadcast(n)).withColumn("next", (F.col("node_id") + 1) % F.col("n")).join(e.select(F.col("node_id").alias("next"), "vector"), "next")
    first = e.where("node_id % 7 <> 0").select("node_id", F.lit(10).cast("long").alias("ts"), "vector", "model_id")
    late = e.where("node_id % 7 = 0 and node_id % 3 <> 0").select("node_id", F.lit(20).cast("long").alias("ts"), "vector", "model_id")
    return first.unionByName(late).unionByName(shifted.select("node_id", F.lit(20).cast("long").alias("ts"), "vector", "model_id")).withColumn("seq", F.lit(0).cast("long"))
