"""Snapshots, bounded traversal and reachability over live edges."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Unavailable
from .temporal import oriented

# fixed values: largest hops, nodes, edges, fan-out and expanded nodes
MAX_HOPS, MAX_NODES, MAX_EDGES, MAX_FAN_OUT, MAX_EXPANDED = 4, 10_000, 50_000, 512, 5_000


def persisted(df: DataFrame, tag: str) -> DataFrame:
    """A table in the session's shared checkpoint folder (in local mode one of our own); lineage ends there."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise Unavailable("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = os.path.join(root, f"graph-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fan_out(live: DataFrame, cap: int, direction: str = "both", window: tuple[int, int] | None = None) -> DataFrame:
    """Edges a traversal may follow: per anchor and type, each direction's newest cap + 1 live edges, then the
    time window, then the first ``cap`` of both by (other, time). ``capped`` says that some were left out."""
    newest = Window.partitionBy("anchor", "edge_type", "outgoing").orderBy(F.col("ts").desc(), "other")
    o = oriented(live, direction).withColumn("_rank", F.row_number().over(newest))
    o = o.where(F.col("_rank") <= cap + 1)
    probe = Window.partitionBy("anchor", "edge_type")
    if window and window != (0, 0):
        o = o.withColumn("_over", F.max("_rank").over(probe) > cap).where(F.col("ts").between(*window))
    else:
        o = o.withColumn("_over", F.max("_rank").over(probe) > cap)
    merged = Window.partitionBy("anchor", "edge_type").orderBy("other", "ts", "outgoing")
    o = o.withColumns({"_place": F.row_number().over(merged), "_all": F.count(F.lit(1)).over(probe)})
    return o.withColumn("capped", F.col("_over") | (F.col("_all") > cap)).where(F.col("_place") <= cap).drop("_rank", "_over", "_place", "_all")


def traverse_set(live: DataFrame, starts: DataFrame, hops: int, direction: str = "both", cap: int | None = MAX_FAN_OUT, types: list[int] | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Nodes reached from each start (request, node) and in how many hops; for all requests in one job.

    No node or edge budget applies, and with ``cap`` None no fan-out cap either. Each hop is a join on the anchor
    and an anti join on what was reached.
    """
    if types:
        live = live.where(F.col("edge_type").isin(sorted(set(types))))
    if cap is not None:
        followed = fan_out(live, cap, direction, window)
    else:
        followed = oriented(live.where(F.col("ts").between(*window)) if window and window != (0, 0) else live, direction)
    steps = persisted(followed.select(F.col("anchor").alias("node"), "other").distinct(), "steps")
    reached = starts.select("request", "node", F.lit(0).alias("hops")).distinct()
    frontier = reached
    for hop in range(1, min(max(hops, 0), MAX_HOPS) + 1):
        found = frontier.join(steps, "node").select("request", F.col("other").alias("node")).distinct()
        frontier = persisted(found.join(reached, ["request", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    return reached


@dataclass
class Traversal:
    """Nodes (node, hops), edges in discovery order, and what was left out."""

    nodes: list[tuple[int, int]]
    edges: list[tuple[int, int, int, int]]
    hops: int
    truncation: dict


def traverse_exact(live: DataFrame, start: int, hops: int, direction: str = "both", cap: int = MAX_FAN_OUT, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, max_expanded: int = MAX_EXPANDED, types: list[int] | None = None, window: tuple[int, int] | None = None) -> Traversal:
    """One bounded breadth-first search, first in first out, with budgets checked edge by edge.

    The frontier's edges come from one job a hop; what reaches the driver is bounded by the frontier's
    size times the types times the fan-out cap, and the frontier by the expansion budget.
    """
    hops = min(max(hops, 0), MAX_HOPS)
    cap, max_nodes, max_edges = min(cap, MAX_FAN_OUT), min(max_nodes, MAX_NODES), min(max_edges, MAX_EDGES)
    if types:
        live = live.where(F.col("edge_type").isin(sorted(set(types))))
    steps = fan_out(live, cap, direction, window)
    depth, order, seen, edges = {start: 0}, [start], set(), []
    flags = {"fanout_capped_nodes": 0, "node_limit": False, "edge_limit": False, "expansion_limit": False}
    frontier, expanded, stop = [start], 0, False
    for hop in range(hops):
        if not frontier or stop:
            break
        allowed = frontier[:max(0, max_expanded - expanded)]
        flags["expansion_limit"] |= len(allowed) < len(frontier)
        expanded += len(allowed)
        rows = steps.where(F.col("anchor").isin(allowed)).select("anchor", "edge_type", "other", "ts", "src", "dst", "capped").collect()
        by = {}
        for r in rows:
            by.setdefault(r["anchor"], []).append(r)
        following = []
        for node in allowed:
            own = sorted(by.get(node, []), key=lambda r: (r["edge_type"], r["other"], r["ts"]))
            flags["fanout_capped_nodes"] += len({r["edge_type"] for r in own if r["capped"]})
            for r in own:
                key = (r["src"], r["dst"], r["edge_type"])
                if key not in seen:
                    if len(edges) >= max_edges:
                        flags["edge_limit"] = stop = True
                        break
                    seen.add(key)
                    edges.append((r["src"], r["edge_type"], r["dst"], r["ts"]))
                if r["other"] not in depth:
                    if len(depth) >= max_nodes:
                        flags["node_limit"] = stop = True
                        break
                    depth[r["other"]] = hop + 1
                    following.append(r["other"])
            if stop:
                break
        order += following
        frontier = following
    return Traversal(sorted(depth.items(), key=lambda x: (x[1], x[0])), edges, hops, flags)


def reach_two(live: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct nodes within two undirected hops of each start (request, node), the start left out; no cap."""
    step = oriented(live, "both").select(F.col("anchor").alias("node"), "other").distinct()
    one = starts.join(step, "node").select("request", F.col("node").alias("start"), F.col("other").alias("node"))
    two = one.join(step, "node").select("request", "start", F.col("other").alias("node"))
    return one.union(two).where("node <> start").select("request", "node").distinct()


def snapshot(live_edges: DataFrame, live_nodes: DataFrame, subjects: DataFrame, cap: int = MAX_FAN_OUT, types: list[int] | None = None) -> DataFrame:
    """One-hop care snapshots of many subjects (column node_id): live subjects only, outgoing edges, per type the
    ``cap`` lowest targets, each with the target's own state (null where it does not exist) and how many were left out."""
    known = subjects.join(live_nodes.select("node_id"), "node_id", "left_semi")
    if types:
        live_edges = live_edges.where(F.col("edge_type").isin(types))
    w = Window.partitionBy("src", "edge_type")
    own = live_edges.join(known.select(F.col("node_id").alias("src")), "src", "left_semi")
    own = own.withColumns({"_place": F.row_number().over(w.orderBy("dst")), "_all": F.count(F.lit(1)).over(w)}).where(F.col("_place") <= cap)
    own = own.withColumn("dropped", F.greatest(F.col("_all") - cap, F.lit(0))).drop("_place", "_all")
    return own.join(live_nodes.select(F.col("node_id").alias("dst"), F.col("node_type").alias("target_type")), "dst", "left")


def degrees(live: DataFrame) -> DataFrame:
    """Live in and out degree of every node that has an edge."""
    out = live.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = live.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node_id", "full").select("node_id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))
