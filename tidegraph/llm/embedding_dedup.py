"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .support import map_batches, materialize, partitions_for, ship_package

THRESHOLD = 0.95
WINDOW = 48
BLOCK = 1024
#: Vectors a pass still to be made up to which all their pairs are compared instead, and the size of those blocks.
EXACT, EXACT_BLOCK = 480, 4096
#: Signs in a key; allowed chance that a pair just at the threshold is missed.
BITS, MISSED = 62, 0.01
SEED = 20240607


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes to begin with: enough where the signs spread the vectors evenly; ``chances`` measures whether they do.

    Two vectors agree in a sign bit with probability 1 - angle / pi. They surely stand in one window when
    they agree in so many leading bits that fewer than ``window`` of the rows do.
    """
    bits = max(1.0, math.log2(max(2, rows) / window) + 1)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(missed) / math.log(1 - agree))) if agree < 1 else 4


def chances(group: np.ndarray, keys: np.ndarray, threshold: float, window: int) -> np.ndarray:
    """For each of a task's sorted rows, the least chance that a vector just at the threshold stands in its window.

    The row ``window`` places on shares some leading bits; what agrees in one more stands before it. Rows
    whose window reaches over an end of the task have chance 0.
    """
    agree = 1 - math.acos(threshold) / math.pi

    def one_way(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        if len(keys) > window:
            differ = keys[window:] ^ keys[:-window]
            high = differ >> 31
            bits = BITS + 1 - np.where(high > 0, 31 + np.frexp(high)[1], np.frexp(differ & ((1 << 31) - 1))[1])
            out[:-window] = np.where(group[window:] != group[:-window], 1.0, np.where(bits > BITS, 0.0, agree ** bits))
        return out

    return np.minimum(one_way(group, keys), one_way(group[::-1], keys[::-1])[::-1])


def forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph with this symmetric matrix."""
    left, right = [], []
    new = np.ones(len(near), bool)
    for start in range(len(near)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            a = todo.pop()
            own = np.flatnonzero(near[a] & new)
            new[own] = False
            left += [a] * len(own)
            right += own.tolist()
            todo += own.tolist()
    return left, right


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(x: np.ndarray, turn: int) -> np.ndarray:
    """The signs of BITS random projections of pass ``turn``, first sign highest."""
    planes = np.random.default_rng((SEED, turn, x.shape[1])).standard_normal((x.shape[1], BITS))
    return ((x @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Vectors linked by cosine >= ``threshold`` in double precision, their components and numbers of links.

    Equal vectors are one class. In each pass the classes are ordered by their concatenated sign hashes
    (range partitioned, sorted) and each is compared with the next 48; a window's verified pairs are joined
    to trees before they leave the task, so a pass makes at most one link a vector. The union over the
    passes gives components. Then each component's vectors are compared in blocks of 1024 for the exact
    number of links within it. A link between two components can be missed only if the pair never met in a
    window: from the leading bits that the rows a window apart share, each pass gives every vector a least
    chance to meet one just at the threshold. The vectors for which the product of the misses is still over
    one in a hundred (dense groups) take as many passes again, among themselves, until none are left or
    comparing all their pairs in blocks costs less than the passes that they would need.

    Null vectors, vectors with null, NaN or infinite components and zero vectors link with nothing, nor do
    vectors of different lengths with each other. Rows with the same id count as copies of it. Null ids get
    null components. An empty table gives an empty result; other columns are ignored.
    Returns vec_id, n_links, component_id, kept.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    sound = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0), F.lit(False))
    v = v.withColumn("e", F.when(sound, F.transform("e", lambda x: x + F.lit(0.0))))
    v = v.withColumns({"h": F.when(F.col("e").isNotNull(), F.xxhash64("e")), "g": F.when(F.col("e").isNotNull(), F.hash("e"))})
    v = materialize(v, "vectors")
    reps = materialize(v.where("e is not null").groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e")).where("rep is not null").withColumn("dim", F.size("e")), "vector-classes")
    rows = reps.count()
    first = passes_for(rows, threshold, window)

    def passes(some: DataFrame, n: int, begin: int, end: int) -> DataFrame:
        """Links (a, b, null) and each vector's log chance of a miss (a, null, miss) from passes begin to end - 1."""

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    x = _matrix(part.column("e"))
                    for turn in range(begin, end):
                        n = len(part)
                        yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, turn, np.int32)), pa.array(_keys(x, turn)), part.column("rep"), pa.array([r.tobytes() for r in x], pa.binary())], ["dim", "turn", "key", "rep", "x"])

        keyed = map_batches(some.select("rep", "dim", "e"), project, "dim int, turn int, key long, rep long, x binary")
        ordered = keyed.repartitionByRange(partitions_for(n * (end - begin), 100_000, 4), "dim", "turn", "key", "rep").sortWithinPartitions("dim", "turn", "key", "rep")
        return materialize(map_batches(ordered, compare, "a long, b long, miss double"), "vector-passes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            seen.append((batch.column("dim").to_numpy().astype(np.int64) << 32 | batch.column("turn").to_numpy(), batch.column("key").to_numpy(), batch.column("rep").to_numpy()))
            table = pa.concat_tables([tail, table]) if tail is not None else table
            tail = table.slice(max(0, len(table) - window))
            group = table.column("dim").to_numpy().astype(np.int64) << 32 | table.column("turn").to_numpy()
            ids = table.column("rep").to_numpy()
            raw = table.column("x").to_pylist()
            roots = {}

            def top(a: int) -> int:
                while roots.get(a, a) != a:
                    roots[a] = roots.get(roots[a], roots[a])
                    a = roots[a]
                return a

            left, right = [], []
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:]):
                x = np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, -1)
                for step in range(1, min(window, b - a - 1) + 1):
                    for i in np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold).tolist():
                        p, q = int(ids[a + i]), int(ids[a + i + step])
                        if top(p) != top(q):
                            roots[max(top(p), top(q))] = min(top(p), top(q))
                            left.append(p)
                            right.append(q)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.nulls(len(left), pa.float64())], ["a", "b", "miss"])
        if seen:
            groups, keys, reps = (np.concatenate(x) for x in zip(*seen))
            miss = np.log1p(-np.minimum(chances(groups, keys, threshold, window), 1 - 1e-9))
            for i in range(0, len(reps), 100_000):
                yield pa.record_batch([pa.array(reps[i:i + 100_000]), pa.nulls(len(reps[i:i + 100_000]), pa.int64()), pa.array(miss[i:i + 100_000])], ["a", "b", "miss"])

    def compare_all(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.combine_chunks()
        block, rep = (table.column(c).to_numpy() for c in ("block", "rep"))
        x = _matrix(table.column("e").chunk(0))
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        left, right = [], []
        # the trees of strips of 512 rows hold all links of the block pair
        for k in range(0, len(one), 512):
            strip = one[k:k + 512]
            near = (x[strip] @ x[two].T) >= threshold
            hit = np.flatnonzero(near.any(axis=0))
            both = np.zeros((len(strip) + len(hit),) * 2, bool)
            both[:len(strip), len(strip):] = near[:, hit]
            both[len(strip):, :len(strip)] = near[:, hit].T
            ids = np.concatenate((rep[strip], rep[two[hit]]))
            a, b = forest(both)
            left.append(ids[a])
            right.append(ids[b])
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (left, right))
        return pa.table([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    ship_package(v.sparkSession)
    links, told, open_, many, done, more = [], None, reps, rows, 0, first
    while many:
        made = passes(open_, many, done, done + more)
        done += more
        links.append(made.where("b is not null").select("a", "b"))
        now = made.where("b is null").select("a", "miss")
        told = now if told is None else told.union(now)
        # the vectors that left earlier stay out, as their chances only fell
        missed = told.groupBy("a").agg(F.sum("miss").alias("miss")).where(F.col("miss") > math.log(MISSED))
        open_ = materialize(reps.join(missed.withColumnRenamed("a", "rep"), "rep").select("rep", "dim", "e", "miss"), "vector-open")
        many, total = open_.agg(F.count(F.lit(1)), F.sum("miss")).first()
        if not many:
            break
        rate = -total / many / done
        if rate <= 0 or many <= EXACT * (-math.log(MISSED) / rate - done):
            blocks = -(-many // EXACT_BLOCK)
            dealt = open_.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            dealt = dealt.select("dim", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block", "rep", "e")
            links.append(materialize(dealt.groupBy("dim", "i", "j").applyInArrow(compare_all, "a long, b long"), "vector-open-links"))
            break
        more = done
    links = reduce(DataFrame.union, links).distinct() if links else reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    labels = materialize(components(links), "vector-components")
    inside = reps.join(labels.toDF("rep", "component"), "rep").select("component", "rep", "copies", "dim", "e")
    sizes = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = materialize(inside.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "vector-blocks")
    # block pairs (i, j), i <= j: each vector goes to the pairs that hold its block
    pairs = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block", "rep", "copies", "e")

    def count(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.combine_chunks()
        block, rep, copies = (table.column(c).to_numpy() for c in ("block", "rep", "copies"))
        x = _matrix(table.column("e").chunk(0))
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (x[one] @ x[two].T) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            ids, n = rep[one], near.astype(np.int64) @ copies[two]
        else:
            ids, n = np.concatenate((rep[one], rep[two])), np.concatenate((near.astype(np.int64) @ copies[two], near.T.astype(np.int64) @ copies[one]))
        return pa.table([pa.array(ids), pa.array(n)], ["rep", "n"])

    linked = pairs.groupBy("component", "i", "j").applyInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    classes = materialize(reps.join(linked, "rep", "left").join(labels.toDF("rep", "component"), "rep", "left").select("h", "g", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes-told")
    good = v.where("e is not null").select("vec_id", "h", "g").join(classes, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    bad = v.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
