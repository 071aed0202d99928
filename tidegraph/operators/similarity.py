"""Cosine top-k over versioned embeddings and its change between two instants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import clamp_k
from .graph import persisted
from .temporal import newest

# rows a block of candidates and of queries; score matrices of 16 MB
CANDIDATES, QUERIES, MOST_PARTS = 4096, 512, 200
BLOCK = "model_a string, model_b string, ids binary, va binary, vb binary"


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of both."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def scores(versions: DataFrame, queries: DataFrame, at: int) -> DataFrame:
    """(query, node, score) for every candidate of the query's model; rounded to six places.

    A node's newest vector counts whatever its model, and only then the model is compared.
    """
    state = newest(versions, ["node_id"], at).select("node_id", "vector", "model_id")
    q = state.join(queries, "node_id").select(F.col("node_id").alias("query"), F.col("vector").alias("q"), "model_id")
    return state.join(q, "model_id").where("node_id <> query").select("query", F.col("node_id").alias("node"), F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score"))


def _sides(versions: DataFrame, times: tuple[int, ...]) -> DataFrame:
    """(node_id, model_a, va, model_b, vb, plain): each node's newest vectors at one or two instants.

    ``plain`` vectors hold finite numbers of common size only, so that sums of products need no special rules.
    """
    fine = lambda v: ~F.exists(v, lambda x: x.isNull() | ~(F.abs(x) <= 1e100))
    sides = []
    for t, name in zip(times, "ab"):
        v = F.col("vector").cast("array<double>")
        sides.append(newest(versions, ["node_id"], t).select("node_id", F.col("model_id").cast("string").alias(f"model_{name}"), v.alias(f"v{name}"), F.coalesce(fine(v), F.lit(False)).alias(f"plain_{name}"), F.lit(True).alias(f"in_{name}")))
    if len(sides) == 1:
        both = sides[0].withColumns({"model_b": F.lit(None).cast("string"), "vb": F.lit(None).cast("array<double>"), "plain_b": F.lit(True), "in_b": F.lit(True)})
    else:
        both = sides[0].join(sides[1], "node_id", "full")
    return both.select("node_id", "model_a", "va", "model_b", "vb", (F.coalesce("plain_a", F.lit(True)) & F.coalesce("plain_b", F.lit(True))).alias("plain"), F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows of equal models packed into blocks of up to ``size``."""
    parts = max(1, min(MOST_PARTS, -(-n // size)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(vectors: list) -> bytes | None:
            if all(v is None for v in vectors):
                return None
            out = np.zeros((len(vectors), max(len(v) for v in vectors if v is not None)))
            for i, v in enumerate(vectors):
                if v is not None:
                    out[i, : len(v)] = v
            return out.tobytes()

        def block(key: tuple, held: list) -> pa.RecordBatch:
            ids = np.array([x[0] for x in held], np.int64)
            columns = [[key[0]], [key[1]], [ids.tobytes()], [matrix([x[1] for x in held])], [matrix([x[2] for x in held])]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["model_a", "model_b", "ids", "va", "vb"])

        key, held = None, []
        for batch in batches:
            lists = [[None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("va", "vb")]
            for node, ma, mb, va, vb in zip(batch.column("node_id").to_pylist(), batch.column("model_a").to_pylist(), batch.column("model_b").to_pylist(), *lists):
                if held and (key != (ma, mb) or len(held) == size):
                    yield block(key, held)
                    held = []
                key = (ma, mb)
                held.append((node, va, vb))
        if held:
            yield block(key, held)

    dealt = rows.select("node_id", "model_a", "model_b", "va", "vb").repartition(parts, "node_id").sortWithinPartitions("model_a", "model_b", "node_id")
    return persisted(dealt.mapInArrow(pack, BLOCK), "blocks")


def _best(candidates: DataFrame, asked: DataFrame, k: int, least: float | None) -> DataFrame:
    """(query, node, sa, sb): at least each query's k best of every pair of blocks, by score or by size of the change.

    Blocks meet as a product, so that neither side is dealt out by the few models there are.
    """

    def side(ids: np.ndarray, raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        m = np.frombuffer(raw).reshape(len(ids), -1) if raw else np.zeros((len(ids), 0))
        return m, np.sqrt((m * m).sum(1))

    def cosines(q: tuple, c: tuple) -> np.ndarray:
        wide = min(q[0].shape[1], c[0].shape[1])
        n = q[1][:, None] * c[1][None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.round(np.where(n > 0, q[0][:, :wide] @ c[0][:, :wide].T / n, 0.0), 6) + 0.0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                s = {x: cosines(side(qi, r[f"q_v{x}"]), side(ci, r[f"v{x}"])) if r[f"model_{x}"] is not None and r[f"model_{x}"] == r[f"q_model_{x}"] else None for x in "ab"}
                if least is None:
                    rank = s["a"].copy()
                elif s["a"] is None or s["b"] is None:
                    rank = np.zeros((len(qi), len(ci)))
                else:
                    rank = np.abs(np.round(s["b"] - s["a"], 6))
                    rank[rank < least] = -np.inf
                rank[qi[:, None] == ci[None, :]] = -np.inf
                last = np.partition(rank, -k, axis=1)[:, -k] if k < len(ci) else np.full(len(qi), -np.inf)
                i, j = np.nonzero((rank >= last[:, None]) & (rank > -np.inf))
                order = np.lexsort((ci[j], -rank[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                arrays = [pa.array(qi[i]), pa.array(ci[j])] + [pa.nulls(len(i), pa.float64()) if s[x] is None else pa.array(s[x][i, j]) for x in "ab"]
                yield pa.RecordBatch.from_arrays(arrays, ["query", "node", "sa", "sb"])

    names = ["model_a", "model_b", "ids", "va", "vb"]
    q = asked.select(*[F.col(c).alias(f"q_{c}") for c in names])
    # two comparisons and not one equality, which would deal out blocks by model
    same = lambda x: (F.col(f"model_{x}") >= F.col(f"q_model_{x}")) & (F.col(f"model_{x}") <= F.col(f"q_model_{x}"))
    pairs = candidates.join(q, same("a") if least is None else same("a") | same("b"))
    return pairs.mapInArrow(compare, "query long, node long, sa double, sb double")


def _pairs(versions: DataFrame, queries: DataFrame, times: tuple[int, ...], k: int, least: float | None) -> DataFrame:
    """(query, node, sa, sb) that hold each query's k best: blocks of plain vectors, and one by one what any other is in."""
    state = persisted(_sides(versions, times), "vectors")
    asked = state.join(queries.distinct(), "node_id", "left_semi").where("in_a and in_b")
    asked = persisted(asked, "asked")
    n, m = state.where("plain").count(), asked.where("plain").count()
    best = _best(_blocks(state.where("plain"), CANDIDATES, n), _blocks(asked.where("plain"), QUERIES, m), k, least)

    def singly(c: DataFrame, q: DataFrame) -> DataFrame:
        q = q.select(*[F.col(x).alias(f"q_{x}") for x in ("node_id", "model_a", "va", "model_b", "vb")])
        found = []
        for x in "ab"[: len(times)]:
            s = F.round(cosine(F.col(f"v{x}"), F.col(f"q_v{x}")), 6)
            found.append(c.join(q, F.col(f"model_{x}") == F.col(f"q_model_{x}")).where("node_id <> q_node_id").select(F.col("q_node_id").alias("query"), F.col("node_id").alias("node"), s.alias(f"s{x}")))
        return found[0].withColumn("sb", F.lit(None).cast("double")) if len(found) == 1 else found[0].join(found[1], ["query", "node"], "full")

    if state.count() > n:  # odd vectors
        best = best.unionByName(singly(state.where("not plain"), asked)).unionByName(singly(state.where("plain"), asked.where("not plain")))
    return best


def top_similar(versions: DataFrame, queries: DataFrame, at: int, k: int = 0) -> DataFrame:
    """Each query's k nearest, ties by id; queries without an embedding give no rows."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    found = _pairs(versions, queries, (at,), clamp_k(k), None).select("query", "node", F.col("sa").alias("score"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= clamp_k(k))


def similarity_delta(versions: DataFrame, queries: DataFrame, low: int, high: int, min_abs: float = 0.0, k: int = 0) -> DataFrame:
    """How similarity changed between two instants: each side's candidates are those of that side's query model.

    Candidates on one side only have delta 0 and are never filtered by ``min_abs``. A query must exist on both sides.
    """
    joined = _pairs(versions, queries, (low, high), clamp_k(k), min_abs).withColumnsRenamed({"sa": "before", "sb": "after"})
    two = F.col("before").isNotNull() & F.col("after").isNotNull()
    joined = joined.withColumn("delta", F.when(two, F.round(F.col("after") - F.col("before"), 6)).otherwise(F.lit(0.0))).withColumn("two_sided", two)
    kept = joined.where(~F.col("two_sided") | (F.abs("delta") >= min_abs))
    w = Window.partitionBy("query").orderBy(F.abs("delta").desc(), "node")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= clamp_k(k)).select("query", "node", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"), "delta", "two_sided", "place")
