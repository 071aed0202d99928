"""Affected subgraphs of mutations, neighbour aggregation in two layers, pending repairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import persisted
from .temporal import oriented


# neighbours that are kept together in one row
CHUNK = 1024
# requests of a node that are told together
SLICE = 256


def capped_neighbours(live: DataFrame, cap: int | None = 512) -> DataFrame:
    """(node, other): per direction the first ``cap`` live edges in the order (type, newest, other), both joined, distinct; None: all."""
    o = oriented(live, "both")
    if cap is not None:
        w = Window.partitionBy("anchor", "outgoing").orderBy("edge_type", F.col("ts").desc(), "other")
        o = o.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap)
    return o.select(F.col("anchor").alias("node"), "other").distinct()


def affected(live: DataFrame, mutations: DataFrame, cap: int | None = 512, hub_degree: int | None = None) -> DataFrame:
    """What each mutation (request, src, dst) changes: rows (request, node, state).

    Endpoints and their neighbours are ``affected``. With a hub degree, a hub's neighbours and any hub among
    the affected become ``deferred`` instead; what is computed now is never also deferred.

    A request's ends are told first, then the neighbours of its first end (one that is no hub, if any), then
    those of the other end that the first lacks: what two ends share is looked up from the end with fewer
    neighbours, so each row is made once and none is dealt out again. Requests of one end are told in slices, each
    neighbour with all requests of a slice: columnar files hold such runs and repetitions in few bytes. Requests
    whose ends share neighbours are told singly, those with more ends go through a distinct.
    """
    steps = persisted(capped_neighbours(live, cap), "neighbours")
    hub = F.lit(False) if hub_degree is None else F.col("n") > hub_degree
    known = persisted(steps.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("hub", hub).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "degrees")
    ends = mutations.select("request", F.explode(F.array("src", "dst")).alias("node")).distinct().join(known, "node", "left")
    ends = ends.withColumns({"n": F.coalesce("n", F.lit(0)), "hub": F.coalesce("hub", F.lit(False))})
    grouped = ends.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("hub", "n", "node", "chunks"))).alias("e"))
    grouped = persisted(grouped, "ends")
    both = grouped.where("size(e) = 2").select("request", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"))
    pairs = both.select(F.col("x.node").alias("first"), F.col("y.node").alias("last"), F.when(F.col("x.n") <= F.col("y.n"), F.col("x.node")).otherwise(F.col("y.node")).alias("node")).distinct()
    few = pairs.join(steps, "node").withColumn("node", F.when(F.col("node") == F.col("first"), F.col("last")).otherwise(F.col("first")))
    shared = persisted(few.join(steps, ["node", "other"], "left_semi").groupBy("first", "last").agg(F.collect_list("other").alias("shared")), "shared")

    state = lambda late: F.when(late, "deferred").otherwise("affected").alias("state")
    told = grouped.where("size(e) <= 2").select("request", F.explode("e").alias("e")).select("request", "e.node", state(F.col("e.hub")))
    first = grouped.where("size(e) <= 2").select("request", F.col("e")[0].alias("x"), F.get("e", F.lit(1))["node"].alias("omit"), F.lit(None).cast("array<long>").alias("shared"))
    last = both.withColumns({"first": F.col("x.node"), "last": F.col("y.node")}).join(shared, ["first", "last"], "left").select("request", F.col("y").alias("x"), F.col("first").alias("omit"), "shared")
    asked = first.unionByName(last).where("x.n > 0").select("request", F.col("x.node").alias("node"), F.col("x.hub").alias("from_hub"), F.col("x.chunks").alias("chunks"), "omit", "shared")
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    alone = asked.where("shared is null")
    slices = alone.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    slices = alone.join(slices, "node").groupBy("node", "from_hub", "chunks", F.pmod(F.xxhash64("request"), F.col("slices")).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("request", "omit"))).alias("asked"))
    slices = persisted(slices, "slices")
    placed = steps.join(known.select("node", "chunks"), "node").withColumn("chunk", F.pmod(F.xxhash64("other"), F.col("chunks")).cast("int"))
    placed = placed.join(known.select(F.col("node").alias("other"), F.col("hub").alias("to_hub")), "other")
    lists = persisted(placed.groupBy("node", "chunk", "to_hub").agg(F.collect_list("other").alias("others")), "lists")
    late = (F.col("from_hub") | F.col("to_hub")).alias("late")
    # a few bytes on either side give many rows, so tasks go by cores
    left, right = (table.repartition(4 * live.sparkSession.sparkContext.defaultParallelism) for table in (slices, lists))
    # a generated stage holds all rows that one input row gives; coalesce ends a stage, and leaves the tasks as they are
    apart = lambda table: table.coalesce(1 << 20)
    near = apart(left.select("node", "from_hub", "asked", chunk).join(right, ["node", "chunk"]).select("node", "asked", late, "others"))
    near = apart(near.select("node", "asked", "late", F.explode("others").alias("other")).where("other <> node"))
    near = near.select("node", "late", "other", F.explode("asked").alias("q")).where("other <> coalesce(q.omit, node)").select("q.request", "other", "late")
    single = asked.where("shared is not null").select("request", "node", "from_hub", "omit", "shared", chunk).join(lists, ["node", "chunk"]).select("request", "node", "omit", "shared", late, F.explode("others").alias("other"))
    single = single.where((F.col("other") != F.col("node")) & (F.col("other") != F.coalesce("omit", "node")) & ~F.array_contains("shared", F.col("other")))
    near = near.unionByName(single.select("request", "other", "late"))
    out = told.unionByName(near.select("request", F.col("other").alias("node"), state(F.col("late"))))

    if grouped.where("size(e) > 2").isEmpty():
        return out
    many = grouped.where("size(e) > 2").select("request", F.explode("e").alias("e")).select("request", "e.node", "e.hub")
    reached = many.join(steps, "node").join(known.select(F.col("node").alias("other"), F.col("hub").alias("to_hub")), "other")
    rows = many.select("request", "node", F.col("hub").alias("late")).unionByName(reached.select("request", F.col("other").alias("node"), (F.col("hub") | F.col("to_hub")).alias("late")))
    return out.unionByName(rows.groupBy("request", "node").agg(F.min("late").alias("late")).select("request", "node", state(F.col("late"))))


def receptive_edges(live: DataFrame, targets: DataFrame, cap: int = 512, budget: int = 1500) -> DataFrame:
    """Undirected edges (request, low, high) that two layers need for the targets (request, node): those of the
    targets and, in id order within the budget, of their neighbours."""
    steps = persisted(capped_neighbours(live, cap), "neighbours")
    one = targets.join(steps, "node").select("request", "node", "other")
    ring = one.select("request", F.col("other").alias("node")).distinct().join(targets, ["request", "node"], "left_anti")
    spent = targets.groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    ring = ring.join(spent, "request").withColumn("_place", F.row_number().over(Window.partitionBy("request").orderBy("node"))).where(F.col("_place") <= F.lit(budget) - F.col("n"))
    two = ring.join(steps, "node").select("request", "node", "other")
    both = one.union(two)
    return both.select("request", F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high")).distinct()


class SageModel:
    """Weights of a two-layer mean-aggregating model; fixed by a seed."""

    def __init__(self, inputs: int, hidden: int = 16, outputs: int = 8, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        shapes = ((inputs, hidden), (hidden, outputs))
        self.layers = [(r.normal(0, 0.3, s), r.normal(0, 0.1, s[1]), r.normal(0, 0.3, s)) for s in shapes]

    def forward(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Rows for all nodes; ``edges`` has a (from, to) row for both directions."""
        for i, (near, bias, own) in enumerate(self.layers):
            total, count = np.zeros_like(x), np.zeros(len(x))
            np.add.at(total, edges[:, 1], x[edges[:, 0]])
            np.add.at(count, edges[:, 1], 1)
            x = total / np.maximum(count, 1)[:, None] @ near + bias + x @ own
            x = np.maximum(x, 0) if i + 1 < len(self.layers) else x
        return x

    def gradient(self, x: np.ndarray, edges: np.ndarray, weights: np.ndarray, target: int) -> np.ndarray:
        """Gradient of the target row's length with respect to the edges' weights."""
        (n1, b1, o1), (n2, b2, o2) = self.layers
        count = np.maximum(np.bincount(edges[:, 1], minlength=len(x)), 1)[:, None]

        def mean(h: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), h.shape[1]))
            np.add.at(out, edges[:, 1], h[edges[:, 0]] * weights[:, None])
            return out / count

        z1 = mean(x) @ n1 + b1 + x @ o1
        h1 = np.maximum(z1, 0)
        y = mean(h1) @ n2 + b2 + h1 @ o2
        dy = np.zeros_like(y)
        dy[target] = y[target] / max(np.linalg.norm(y[target]), 1e-12)
        dm2 = dy @ n2.T / count
        dh1 = dy @ o2.T
        np.add.at(dh1, edges[:, 0], dm2[edges[:, 1]] * weights[:, None])
        dz1 = dh1 * (z1 > 0)
        dm1 = dz1 @ n1.T / count
        return (dm2[edges[:, 1]] * h1[edges[:, 0]]).sum(1) + (dm1[edges[:, 1]] * x[edges[:, 0]]).sum(1)


class GatModel:
    """Two attention layers with self-loops: four heads side by side, then one."""

    def __init__(self, inputs: int, hidden: int = 8, heads: int = 4, outputs: int = 8, seed: int = 13) -> None:
        r = np.random.default_rng(seed)
        self.layers = [(r.normal(0, 0.3, (heads, inputs, hidden)), r.normal(0, 0.3, (2, heads, hidden))), (r.normal(0, 0.3, (1, heads * hidden, outputs)), r.normal(0, 0.3, (2, 1, outputs)))]

    def forward(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        loops = np.arange(len(x))
        a, b = np.concatenate((edges[:, 0], loops)), np.concatenate((edges[:, 1], loops))
        for i, (w, att) in enumerate(self.layers):
            outs = []
            for k in range(len(w)):
                h = x @ w[k]
                e = h[a] @ att[0, k] + h[b] @ att[1, k]
                e = np.where(e > 0, e, 0.2 * e)
                top = np.full(len(x), -np.inf)
                np.maximum.at(top, b, e)
                e = np.exp(e - top[b])
                total = np.zeros(len(x))
                np.add.at(total, b, e)
                out = np.zeros((len(x), h.shape[1]))
                np.add.at(out, b, h[a] * (e / total[b])[:, None])
                outs.append(out)
            x = np.concatenate(outs, axis=1)
            x = np.where(x > 0, x, np.expm1(np.minimum(x, 0))) if i + 1 < len(self.layers) else x
        return x


def embed_targets(edges: DataFrame, features: DataFrame, targets: DataFrame, model) -> DataFrame:
    """Vectors of the targets (request, node), one group a request: its undirected edges (request, low, high) and
    the features (node, x) of their nodes. A node without features has zeros."""
    width = len(features.select("x").first()["x"])
    nodes = edges.select("request", F.col("low").alias("node")).union(edges.select("request", F.col("high").alias("node"))).union(targets.select("request", "node")).distinct()
    rows = nodes.join(features, "node", "left").select("request", "node", "x", F.lit(None).cast("long").alias("other"), F.lit(0).alias("kind"))
    links = edges.select("request", F.col("low").alias("node"), F.lit(None).cast("array<double>").alias("x"), F.col("high").alias("other"), F.lit(1).alias("kind"))
    wanted = targets.select("request", "node", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("long").alias("other"), F.lit(2).alias("kind"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.kind == 0].sort_values("node")
        place = {n: i for i, n in enumerate(own.node)}
        x = np.array([v if v is not None else [0.0] * width for v in own.x], float).reshape(len(own), width)
        link = pdf[pdf.kind == 1].sort_values(["node", "other"])
        pairs = np.array([(place[a], place[int(b)]) for a, b in zip(link.node, link.other)], np.int64).reshape(-1, 2)
        y = model.forward(x, np.concatenate((pairs, pairs[pairs[:, 0] != pairs[:, 1]][:, ::-1])))
        ask = sorted(pdf[pdf.kind == 2].node)
        return pd.DataFrame({"request": [key[0]] * len(ask), "node": ask, "vector": [y[place[n]].tolist() for n in ask]})

    return rows.unionByName(links).unionByName(wanted).groupBy("request").applyInPandas(run, "request long, node long, vector array<double>")


def attribution(model: SageModel, x: np.ndarray, edges: np.ndarray, target: int, steps: int = 16, top: int = 20) -> dict:
    """Integrated gradients over the edges' weights from 0 to 1, midpoint rule: the largest shares, the rest, and
    how far their sum is from the change explained."""
    grads = sum(model.gradient(x, edges, np.full(len(edges), (k + 0.5) / steps), target) for k in range(steps)) / steps
    order = sorted(range(len(edges)), key=lambda i: (-abs(grads[i]), tuple(edges[i])))
    empty = np.zeros((0, 2), np.int64)
    whole = np.linalg.norm(model.forward(x, edges)[target]) - np.linalg.norm(model.forward(x, empty)[target])
    return {"top": [(int(edges[i][0]), int(edges[i][1]), float(grads[i])) for i in order[:top]], "rest_sum": float(sum(grads[i] for i in order[top:])), "rest_count": max(0, len(order) - top), "residual": float(grads.sum() - whole)}


def mean_of_neighbours(edges: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """(node, x): the mean feature vector of each node's undirected neighbours, JVM-side, one column a dimension."""
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).union(edges.select("high", "low")).where("node <> other").distinct()
    joined = both.join(features.withColumnRenamed("node", "other"), "other")
    return joined.groupBy("node").agg(*[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(width)])


def pending_repairs(markers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The newest marker of each node that no embedding at or after it answers."""
    last = markers.groupBy("node_id").agg(F.max(F.struct("ts", "reason", "model_id")).alias("m")).select("node_id", F.col("m.ts").alias("marked_at"), F.col("m.reason").alias("reason"), F.col("m.model_id").alias("model_id"))
    done = embeddings.groupBy("node_id").agg(F.max("ts").alias("embedded_at"))
    return last.join(done, "node_id", "left").where("embedded_at is null or embedded_at < marked_at")


def claim_repairs(pending: DataFrame, n: int) -> DataFrame:
    return pending.orderBy("model_id", "marked_at", "node_id").limit(n)
