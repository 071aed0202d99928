"""Minimax contiguous sharding by hash cells, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize

KEY_BITS, LEVEL_BITS = 60, 12
SALTS, SALT_ROWS = 16, 250_000


def greedy_ends(ends: list[int], solid: list[bool], shards: int, capacity: int, fluid: bool) -> list[int] | None:
    """Cumulative sizes at which a greedy fill of ``capacity`` cuts, or None if more shards are needed.

    ``ends`` holds running sizes of the ordered cells. With ``fluid``, cells that are not ``solid`` may be
    cut anywhere, which bounds the true capacity from below.
    """
    at, cuts = 0, []
    total = ends[-1] if ends else 0
    for _ in range(shards):
        if at >= total:
            cuts.append(total)
            continue
        i = bisect_right(ends, at + capacity)
        upto = ends[i - 1] if i else 0
        if fluid and i < len(ends) and not solid[i]:
            upto = at + capacity
        if upto <= at:
            return None
        at = upto
        cuts.append(at)
    return cuts if at >= total else None


def least_capacity(ends: list[int], solid: list[bool], shards: int, fluid: bool) -> int:
    """Binary search for the smallest feasible capacity."""
    if not ends or not ends[-1]:
        return 0
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy_ends(ends, solid, shards, mid, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _cells(slim: DataFrame, level: int, inside: list[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
    """Histogram cells (level, prefix, size, one group only) of the whole table or of some parent cells."""
    shift = KEY_BITS - LEVEL_BITS * level
    if inside:
        parent = F.shiftright("h", shift + LEVEL_BITS)
        slim = slim.where(parent.isin([p for _, p in inside]))
    rows = slim.groupBy(F.shiftright("h", shift).alias("p")).agg(F.sum("size").alias("s"), (F.min("h") == F.max("h")).alias("one")).collect()
    return [(level, r["p"], int(r["s"]), bool(r["one"]) or shift == 0) for r in rows]


def thresholds(slim: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which shards 1.. begin, and the capacity reached.

    The first histogram has at most 4096 cells over the key's top bits; only cells in which a cut can
    fall are split by the next 12 bits, so what reaches the driver is bounded whatever the input.
    """
    start = lambda c: c[1] << (KEY_BITS - LEVEL_BITS * c[0])
    cells = sorted(_cells(slim, 1, []), key=start)
    while True:
        ends, solid = list(accumulate(c[2] for c in cells)), [c[3] for c in cells]
        high, low = least_capacity(ends, solid, shards, False), least_capacity(ends, solid, shards, True)
        if not cells:
            return [0] * (shards - 1), 0
        cuts = greedy_ends(ends, solid, shards, high, False)
        if high == low or all(solid):
            break
        early = greedy_ends(ends, solid, shards, low, True)
        split = set()
        for a, b in zip(early, cuts):
            for i in range(max(0, bisect_right(ends, min(a, b)) - 1), min(len(cells), bisect_right(ends, max(a, b)) + 1)):
                if not solid[i]:
                    split.add(i)
        if not split:
            break
        finer = []
        for level in sorted({cells[i][0] for i in split}):
            finer += _cells(slim, level + 1, [(level, cells[i][1]) for i in split if cells[i][0] == level])
        cells = sorted([c for i, c in enumerate(cells) if i not in split] + finer, key=start)
    begin = [bisect_right(ends, cut) for cut in cuts[:-1]]
    return [start(cells[i]) if i < len(cells) else 1 << KEY_BITS for i in begin], high


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` contiguous ranges of its text's hash, sizes near equal.

    Atomic groups are equal texts (they share a hash, so a shard); their order is the hash's. The smallest
    capacity for which a greedy fill needs no more shards is found by binary search over histogram cells,
    refined only where a cut can fall. Slots run without gaps from 0 in each shard: offsets by cell and
    salt come from counts, ranks are taken within these small pieces, so no shard is ranked in one task.
    A cell has 16 salts and one more for each 250,000 of its rows, so a hot group's pieces stay that small;
    the table of salts has a row a cell, 4096 at most, and is broadcast for that.

    Nulls: a null text has size 1 and crc 0, as the empty text has, in a group of its own; null and repeated
    ids are kept, one slot a row. An empty table gives an empty result. A single group larger than a fair
    share makes its shard that large. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    body = F.col(text)
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce(body, F.lit("\u0000null"))), 64 - KEY_BITS)
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), key.alias("h"))
    slim = materialize(slim, "shard-sizes")
    at, _ = thresholds(slim, shards)
    shard = sum((F.when(F.col("h") >= F.lit(x), 1).otherwise(0) for x in at), F.lit(0)).cast("int")
    slim = slim.withColumns({"shard": shard, "cell": F.shiftright("h", KEY_BITS - LEVEL_BITS)})
    salts = materialize(slim.groupBy("cell").agg((F.lit(SALTS) + F.floor(F.count(F.lit(1)) / F.lit(SALT_ROWS))).alias("salts")), "shard-salts")
    placed = slim.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    counts = placed.groupBy("shard", "cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = materialize(counts.withColumn("before", F.sum("n").over(run) - F.col("n")).drop("n"), "shard-offsets")
    rank = F.row_number().over(Window.partitionBy("shard", "cell", "salt").orderBy("h", "doc_id", "size")) - 1
    ranked = placed.withColumn("rank", rank).join(offsets, ["shard", "cell", "salt"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
