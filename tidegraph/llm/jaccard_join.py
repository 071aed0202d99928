"""Size-aware heavy-light Jaccard self-join on five-word shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .support import byte_groups, discard, map_batches, materialize, partitions_for, total_bytes
from .words import Words, mix

#: Similarity as a whole percentage.
PERCENT = 75
#: Matches asked for in the prefixes of two sets of MANY elements or more.
MATCHES, MANY = 3, 24
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 16
#: Elements in more sets than this go to the end of the order; at most HOT_KEPT are remembered (4 bytes each).
HOT, HOT_KEPT = 48, 262_144
BUCKET_BYTES = 16 << 20
#: Classes in a block, and pairs around one key that are tested in one place.
CROWD = 256
#: Bytes that a counted pair costs in one list, against 8 for each element of a set.
PAIR_BYTES = 24
#: Pairs whose matches are counted at once.
HELD = 1 << 20
_ODD = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n: int) -> int:
    """Elements that a set of n must share with any set it links with."""
    return -(-PERCENT * n // 100)


def matches_for(n):
    return np.where(np.asarray(n) >= MANY, MATCHES, 1)


def needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Prefix elements that two sets of these sizes share at least if they link.

    What the set whose prefix ends first shares with the other lies in the other's prefix or after its own.
    """
    overlap = -(-PERCENT * (x + y) // (100 + PERCENT))
    after = np.maximum(-(-PERCENT * x // 100) - matches_for(x), -(-PERCENT * y // 100) - matches_for(y))
    return np.maximum(overlap - after, 1)


def set_key(u: np.ndarray) -> int:
    """A set's class key: 64 bits of a hash over its sorted elements."""
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(u: np.ndarray, length: int, hot: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """The first elements of the sorted set in the order (hot, hash); any fixed hot set keeps the join exact."""
    length = min(length, len(u))
    first = u[:length]
    if not len(hot) or not _is_hot(first, hot, maybe).any():
        return first
    flags = _is_hot(u, hot, maybe)
    cold = u[~flags][:length]
    return np.concatenate((cold, u[flags][:length - len(cold)]))


def _is_hot(u: np.ndarray, hot: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    out = maybe[(u >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        top = (u[at] >> np.uint64(32)).astype(np.uint32)
        where = np.searchsorted(hot, top)
        out[at] = (where < len(hot)) & (hot[np.minimum(where, len(hot) - 1)] == top)
    return out


def _filter(hot: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 20, bool)
    maybe[(hot >> np.uint32(12)).astype(np.int64)] = True
    return maybe


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for a, b in byte_groups(batch, "text", 2 << 20):
            yield batch.column("doc_id").slice(a, b - a).to_pylist(), [np.unique(x) for x in Words(batch.column("text").slice(a, b - a).to_pylist()).sequences()]


def _buckets(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * _ODD) >> np.uint64(33)).astype(np.int64) % n


def _dealt(n: int, key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Arrays split by bucket of ``key``, as bytes; the order inside a bucket stays."""
    where = _buckets(key, n)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(n + 1))
    arrays = [x[order] for x in arrays]
    for i in range(n):
        if cuts[i + 1] > cuts[i]:
            yield i, [x[cuts[i]:cuts[i + 1]].tobytes() for x in arrays]


def pack_sorted(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Distinct sorted 32-bit values with counts: gaps in 16 bits, wide gaps, and the counts over one."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    wide = gaps >= 65535
    many = np.flatnonzero(counts > 1)
    return [np.where(wide, 65535, gaps).astype(np.uint16).tobytes(), gaps[wide].astype(np.uint32).tobytes(), np.stack((many, counts[many])).astype(np.uint32).tobytes()]


def unpack_sorted(gaps: bytes, wide: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.frombuffer(gaps, np.uint16).astype(np.int64)
    gaps[gaps == 65535] = np.frombuffer(wide, np.uint32)
    counts = np.ones(len(gaps), np.int64)
    at, n = np.frombuffer(many, np.uint32).reshape(2, -1)
    counts[at] = n
    return np.cumsum(gaps).astype(np.uint32), counts


def frequent_elements(docs: DataFrame, buckets: int) -> tuple[np.ndarray, dict[int, int], float]:
    """Over all documents and all elements: top halves of the hashes in more than HOT sets, the number of
    sets of each small size, and the mean length of the list in which an element stands.

    Counts are per task and then per range of hashes; what reaches the driver is bounded by HOT_KEPT.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, small = [], 0, set(), np.zeros(MANY, np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal held, size, small
            top = np.sort(np.concatenate(held))
            begins = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
            n = np.diff(np.append(begins, len(top)))
            top = top[begins]
            cuts = np.searchsorted(top, np.arange(buckets + 1, dtype=np.int64) * (1 << 32) // buckets)
            rows = [(i, *pack_sorted(top[x:y], n[x:y])) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            rows.append((-1, *pack_sorted(np.arange(1, MANY), small[1:])))
            held, size, small = [], 0, np.zeros(MANY, np.int64)
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3)]], ["bucket", "gaps", "wide", "many"])

        for _, sets in _sets(batches):
            for u in sets:
                key = set_key(u)
                if len(u) < 3 or key in seen:
                    continue
                seen.add(key)
                small[len(u) if len(u) < MANY else 0] += 1
                held.append((u >> np.uint64(32)).astype(np.uint32))
                size += len(u)
            if size > 2_000_000:
                yield flush()
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(*(x.as_py() for x in row)) for row in zip(*(table.column(c) for c in ("gaps", "wide", "many")))]
        top, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        if table.column("bucket")[0].as_py() < 0:
            # sizes without a set count one here for each blob
            sums = np.bincount(top, n, MANY)[1:].astype(np.int64)
            return pa.table([pa.array(-3 - np.arange(1, MANY)), pa.array(sums)], ["top", "n"])
        order = np.argsort(top, kind="stable")
        top, n = top[order], n[order]
        begins = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        sums = np.add.reduceat(n, begins)
        keep = sums > HOT
        light = sums[~keep]
        total = np.array([int((light * light).sum()), int(light.sum())])
        return pa.table([pa.array(np.concatenate((top[begins][keep].astype(np.int64), [-1, -2]))), pa.array(np.concatenate((sums[keep], total)))], ["top", "n"])

    blobs = map_batches(docs, count, "bucket int, gaps binary, wide binary, many binary")
    found = materialize(blobs.groupBy("bucket").applyInArrow(add, "top long, n long"), "jaccard-elements")
    hot = found.where("top >= 0").orderBy(F.desc("n"), "top").limit(HOT_KEPT).select("top").toArrow()
    told = {r["top"]: r["n"] for r in found.where("top < 0").groupBy("top").agg(F.sum("n").alias("n")).collect()}
    length = told.get(-1, 0) / max(1, told.get(-2, 0))
    discard(found)
    return np.sort(hot.column("top").to_numpy().astype(np.uint32)), {n: told.get(-3 - n, 0) for n in range(1, MANY)}, length


def light_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest set size whose sets enumerate pairs of prefix elements instead of scanning lists.

    Enumerating costs a row for each pair of elements; scanning costs, for each prefix element, the
    length of its list. The boundary makes the sum over all sets least.
    """

    def pairs(n: int) -> int:
        p = min(n, n - least_overlap(n) + 2)
        return p * (p - 1) // 2

    def scan(n: int) -> float:
        return (n - least_overlap(n) + 1) * (1 + list_length)

    best, cost, least = 2, 0.0, 0.0
    for n in range(3, MANY):
        cost += sizes.get(n, 0) * (pairs(n) - scan(n))
        if cost <= least and pairs(n) <= scan(n):
            best, least = n, cost
    return best


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)


def _counted(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, need = low[order], high[order], need[order]
    if not len(low):
        return low, high, need, need
    begins = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
    return low[begins], high[begins], np.diff(np.append(begins, len(low))), need[begins]


PAIRS, STARS, LONG, DOCS = 1, 2, 3, 0
_OUT = "kind int, a long, b long, n long, need long"


def _out(kind: int, *cols) -> pa.Table:
    cols = [np.asarray(c).astype(np.int64) for c in cols]
    return pa.table([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(pa.array, cols)], ["kind", "a", "b", "n", "need"])


def _list_pairs(sig: np.ndarray, key: np.ndarray, n: np.ndarray, light: int) -> list[pa.Table]:
    """Candidate pairs of one bucket's lists: all pairs of short lists; a star and a chain of long ones."""
    order = np.lexsort((key, sig))
    sig, key, n = sig[order], key[order], n[order]
    keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
    sig, key, n = sig[keep], key[keep], n[keep]
    begins = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    length = np.diff(np.append(begins, len(sig)))
    subsets = (sig & np.uint64(1)).astype(bool)
    left, right = [], []
    for size in range(2, SHORT_LIST + 1):
        at = begins[length == size]
        for i, j in combinations(range(size), 2) if len(at) else ():
            x, y = at + i, at + j
            ok = _near(n[x], n[y]) & (subsets[x] | (np.maximum(n[x], n[y]) > light))
            left.append(x[ok])
            right.append(y[ok])
    tables = []
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        need = np.where(subsets[x], 1, needed(n[x].astype(np.int64), n[y].astype(np.int64)))
        # a pair of two light sets is counted in subsets only, any other in lists only
        tables.append(_out(PAIRS, *_counted(key[x], key[y], need)))
    long = np.flatnonzero(length > SHORT_LIST)
    if len(long):
        rows = np.concatenate([np.arange(begins[i], begins[i] + length[i]) for i in long])
        tables.append(_out(LONG, sig[rows].view(np.int64), key[rows], n[rows], np.zeros(len(rows))))
        x, y = [], []
        for i in long:
            own = np.arange(begins[i], begins[i] + length[i])
            by_size = own[np.lexsort((key[own], n[own]))]
            x += [np.full(len(own) - 1, own[0]), by_size[:-1]]
            y += [own[1:], by_size[1:]]
        x, y = np.concatenate(x), np.concatenate(y)
        ok = _near(n[x], n[y])
        tables.append(_out(STARS, *_counted(key[x[ok]], key[y[ok]], np.ones(int(ok.sum()), np.int64))))
    return tables


def sent(needs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (key, the other columns of ``needs``, elements): the sorted 64-bit elements of each class where it is needed.

    Sets are made from the text of one document of a class, after its only shuffle; repeated rows of that
    document are sent once a task at most.
    """
    places = needs.groupBy("key").agg(F.collect_list(F.struct(*[c for c in needs.columns if c != "key"])).alias("places"))
    reps = classes.join(places, "key").select("key", F.col("rep").alias("doc_id"), "places")
    texts = docs.join(reps, "doc_id").select("key", "places", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in byte_groups(batch, "text", 2 << 20):
                part = batch.slice(a, b - a)
                keep, sets = [], []
                for k, x in zip(part.column("key").to_pylist(), Words(part.column("text").to_pylist()).sequences()):
                    u = np.unique(x) if k not in seen else None
                    keep.append(u is not None and set_key(u) == k)
                    if keep[-1]:
                        seen.add(k)
                        sets.append(u.tobytes())
                part = part.select(["key", "places"]).filter(pa.array(keep, pa.bool_()))
                yield pa.record_batch([*part.columns, pa.array(sets, pa.binary())], ["key", "places", "elements"])

    made = map_batches(texts, build, f"key long, places {places.schema['places'].dataType.simpleString()}, elements binary")
    return made.select("key", F.explode("places").alias("place"), "elements").select("key", "place.*", "elements")


def links_of(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """The pairs (a < b) of class keys whose sets link.

    Pairs go to the bucket of the smallest key near them, so that a group of near copies meets in one
    bucket and each of its sets is sent there once. Where many pairs lie around one key, ``b`` decides too.
    """
    least = pairs.select("a", "b").union(pairs.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    placed = pairs.join(least, "a")
    crowded = placed.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(F.lit(0))
    placed = materialize(placed.join(crowded, "m", "left").select("a", "b", F.pmod(F.xxhash64("m", part), F.lit(buckets)).cast("int").alias("bucket")), "jaccard-placed")
    needs = placed.select("bucket", F.col("a").alias("key")).union(placed.select("bucket", "b")).distinct()
    none = F.lit(None)
    rows = sent(needs, classes, docs).select("bucket", F.col("key").alias("a"), none.cast("long").alias("b"), "elements").union(placed.select("bucket", "a", "b", none.cast("binary")))

    def test(table: pa.Table) -> pa.Table:
        a, b, elements = (table.column(c) for c in ("a", "b", "elements"))
        held = {k: np.frombuffer(e.as_buffer(), np.uint64) for k, e in zip(a.to_pylist(), elements) if e.is_valid}
        pairs = [(x, y) for x, y in zip(a.to_pylist(), b.to_pylist()) if y is not None]
        keep = [(x, y) for x, y in pairs if links_of(held[x], held[y])]
        return pa.table([pa.array([p[i] for p in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    out = materialize(rows.groupBy("bucket").applyInArrow(test, "a long, b long"), "jaccard-links")
    discard(placed)
    return out


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Elements that each set of ``xs`` shares with each of ``ys``: rare elements pair by pair, the others as matrices."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(xs) or not len(ys):
        return out
    sides = []
    for sets in (xs, ys):
        e = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(e, kind="stable")
        e, own = e[order], own[order]
        begin = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1]))) if len(e) else np.zeros(0, np.int64)
        sides.append((e[begin], begin, np.diff(np.append(begin, len(e))), own))
    _, p, q = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    (bx, nx, ox), (by, ny, oy) = (tuple(x[at] for x in side[1:3]) + side[3:] for side, at in zip(sides, (p, q)))
    each = nx * ny
    rare = np.flatnonzero(each <= 64)
    n = each[rare]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, wide = np.repeat(rare, n), np.repeat(ny[rare], n)
    np.add.at(out, (ox[bx[i] + step // wide], oy[by[i] + step % wide]), 1)
    often = np.flatnonzero(each > 64)
    for k in range(0, len(often), 2048):
        own = often[k:k + 2048]
        parts = []
        for begin, n, docs, many in ((bx, nx, ox, len(xs)), (by, ny, oy, len(ys))):
            m = np.zeros((many, len(own)), np.float32)
            n = n[own]
            at = np.repeat(begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            m[docs[at], np.repeat(np.arange(len(own)), n)] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def block_links(keys: np.ndarray, labels: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different labels, between sides 0 and 1 or, where there is no side 1, within side 0; a tree of them is enough."""
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if side.any() else x
    common = common_counts([sets[i] for i in x], [sets[i] for i in y])
    n = np.array([len(s) for s in sets], np.int64)
    near = (labels[x][:, None] != labels[y][None, :]) & (100 * common >= PERCENT * (n[x][:, None] + n[y][None, :] - common))
    roots: dict[int, int] = {}

    def top(a: int) -> int:
        while roots.get(a, a) != a:
            roots[a] = roots.get(roots[a], roots[a])
            a = roots[a]
        return a

    out = []
    for i, j in zip(*np.nonzero(near)):
        p, q = top(int(labels[x[i]])), top(int(labels[y[j]]))
        if p != q:
            roots[max(p, q)] = min(p, q)
            out.append((int(keys[x[i]]), int(keys[y[j]])))
    return out


def enough_matches(met: pa.Table, more: pa.Table, light: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a < b) of different labels that share as many prefix elements as their sizes ask for.

    ``met`` has a row for each two blocks (x, y) and list in which they meet, with the members of both there;
    ``more`` the matches of pairs in short lists. A class has one block, so a pair's matches are all in one task;
    those of a few blocks at once are held as pairs.
    """
    x, y, sig = (met.column(c).to_numpy() for c in ("x", "y", "sig"))
    sides = []
    for c in ("xs", "ys"):
        lists = met.column(c).combine_chunks()
        own = lists.flatten()
        ends = np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy().astype(np.int64))))
        sides.append((ends, *(own.field(f).to_numpy() for f in ("key", "n", "label"))))
    (ex, kx, nx, lx), (ey, ky, ny, ly) = sides
    order = np.lexsort((y, x))
    each = (np.diff(ex) * np.diff(ey))[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0), [True]))) if len(x) else np.zeros(1, np.int64)
    total = np.concatenate(([0], np.cumsum(each)))
    ma, mb, mn = (more.column(c).to_numpy() for c in ("a", "b", "n"))
    found = [(np.zeros(0, np.int64),) * 2]
    g = 0
    while g < len(new) - 1:
        # whole pairs of blocks, with about HELD pairs of classes
        h = max(g + 1, int(np.searchsorted(total[new], total[new[g]] + HELD, side="right")) - 1)
        rows, n = order[new[g]:new[h]], each[new[g]:new[h]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide, row = np.repeat(np.diff(ey)[rows], n), np.repeat(rows, n)
        i, j = ex[row] + step // wide, ey[row] + step % wide
        subsets = (sig[row] & 1).astype(bool)
        ok = (lx[i] != ly[j]) & ((x[row] != y[row]) | (kx[i] < ky[j])) & _near(nx[i], ny[j]) & (subsets | (np.maximum(nx[i], ny[j]) > light))
        i, j, subsets = i[ok], j[ok], subsets[ok]
        a, b, n, need = _counted(kx[i], ky[j], np.where(subsets, 1, needed(nx[i], ny[j])))
        # those with too few in long lists may have the rest in short ones
        low = np.flatnonzero(n < need)
        if len(low) and len(ma):
            own = np.flatnonzero(np.isin(ma, a[low]) & np.isin(mb, b[low]))
            all_a, all_b = np.concatenate((a[low], ma[own])), np.concatenate((b[low], mb[own]))
            by = np.lexsort((np.repeat((0, 1), (len(low), len(own))), all_b, all_a))
            same = np.flatnonzero((np.diff(all_a[by]) == 0) & (np.diff(all_b[by]) == 0))
            n[low[by[same]]] += mn[own[by[same + 1] - len(low)]]
        found.append((a[n >= need], b[n >= need]))
        g = h
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def cross_links(open_lists: DataFrame, met_pairs: DataFrame, done: DataFrame, classes: DataFrame, docs: DataFrame, light: int, buckets: int) -> DataFrame:
    """Links between components that meet in long lists, given these lists' rows (sig, key, n, label).

    A class has its home in the smallest of its lists. The classes of a home and a band of sizes fall in
    blocks of about CROWD, those of a large component apart from the others; blocks of one large component
    or of bands that are no neighbours are never compared. Two blocks that meet in lists are compared as a
    whole where their sets are fewer bytes than the pairs in their lists, so that neither pairs nor lists of
    a crowd leave a task; otherwise their pairs' matches are counted in one task, with those of short lists
    (``met_pairs``), and only pairs with enough leave it; those that are not ``done`` are verified.
    """
    homes = materialize(open_lists.groupBy("key").agg(F.min("sig").alias("home"), F.min("label").alias("label"), F.min("n").alias("n")).withColumn("band", F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9).cast("int")), "jaccard-homes")
    large = homes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).alias("parts")).where("parts > 1")
    marked = homes.join(large, "label", "left")
    mixed = marked.where("parts is null").groupBy("home", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).alias("homes"))
    marked = marked.join(mixed, ["home", "band"], "left")
    one = F.when(F.col("parts").isNotNull(), F.col("label")).alias("one")
    inside = F.when(F.col("parts").isNotNull(), F.xxhash64("home", "band", "label", F.pmod(F.xxhash64("key"), F.col("parts")))).otherwise(F.xxhash64("home", "band", F.pmod(F.xxhash64("label"), F.col("homes"))))
    blocks = materialize(marked.select("key", "label", "n", "band", inside.alias("block"), one), "jaccard-blocks")
    rows = materialize(open_lists.select("sig", "key").join(blocks, "key"), "jaccard-rows")
    there = rows.groupBy("sig", "block").agg(F.first("band").alias("band"), F.first("one").alias("one"), F.count(F.lit(1)).alias("c"))
    other = there.toDF("sig", "block2", "band2", "one2", "c2")
    lists = materialize(there.join(other, "sig").where("block <= block2 and abs(band - band2) <= 1 and not coalesce(one = one2, false) and (block < block2 or c > 1)").select("sig", F.col("block").alias("x"), F.col("block2").alias("y"), (F.col("c") * F.col("c2")).alias("w")), "jaccard-there")
    size = blocks.groupBy("block").agg(F.sum(8 * F.col("n")).alias("bytes"))
    meet = lists.groupBy("x", "y").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("w") / 2).otherwise(F.col("w"))).alias("w")).join(size.toDF("x", "bx"), "x").join(size.toDF("y", "by"), "y")
    meet = materialize(meet.select("x", "y", (F.lit(PAIR_BYTES) * F.col("w") > F.col("bx") + F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("by"))).alias("whole")), "jaccard-block-pairs")

    # blocks compared as a whole
    whole = meet.where("whole").select("x", "y")
    needs = whole.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).union(whole.where("x <> y").select("x", "y", "y", F.lit(1)))
    needs = materialize(needs.join(blocks.select("key", "label", "n", "block"), "block").select("x", "y", "side", "key", "label", "n"), "jaccard-block-needs")
    parts = partitions_for(8 * (needs.agg(F.sum("n")).first()[0] or 0), BUCKET_BYTES, 8)
    dealt = sent(needs.drop("n"), classes, docs).withColumn("bucket", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        x, y, side, key, label = (table.column(c).to_numpy() for c in ("x", "y", "side", "key", "label"))
        elements = table.column("elements")
        order = np.lexsort((y, x))
        cuts = np.flatnonzero(np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]), [True])))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            out += block_links(key[own], label[own], side[own], [np.frombuffer(elements[int(i)].as_buffer(), np.uint64) for i in own])
        return pa.table([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    found = materialize(dealt.groupBy("bucket").applyInArrow(compare, "a long, b long"), "jaccard-cross")

    # matches of pairs of the other blocks, counted where two blocks meet; matches in short lists come there too
    members = rows.groupBy("sig", "block").agg(F.collect_list(F.struct("key", "n", "label")).alias("own"))
    few = lists.select("sig", "x", "y").join(meet.where("not whole").select("x", "y"), ["x", "y"])
    few = few.join(members.toDF("sig", "x", "xs"), ["sig", "x"]).join(members.toDF("sig", "y", "ys"), ["sig", "y"])
    ends = [blocks.select(F.col("key").alias(k), F.col("label").alias(f"l{k}"), F.col("block").alias(f"b{k}")) for k in "ab"]
    more = met_pairs.join(ends[0], "a").join(ends[1], "b").where("la <> lb").groupBy("a", "b", F.least("ba", "bb").alias("x"), F.greatest("ba", "bb").alias("y")).agg(F.sum("n").alias("n"))
    at = F.pmod(F.xxhash64("x", "y"), F.lit(buckets)).cast("int").alias("bucket")

    def count(met: pa.Table, more: pa.Table) -> pa.Table:
        return pa.table(list(enough_matches(met, more, light)), ["a", "b"])

    both = few.withColumn("bucket", at).groupBy("bucket").cogroup(more.withColumn("bucket", at).groupBy("bucket")).applyInArrow(count, "a long, b long")
    second = materialize(both.join(done, ["a", "b"], "left_anti"), "jaccard-second")
    if not second.isEmpty():
        found = found.union(verify(second, classes, docs, buckets))
    discard(homes, blocks, rows, lists, meet, needs)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents linked by Jaccard similarity of their distinct five-word shingles, as components.

    Sets with the same elements form a class, which is joined once. Small sets enumerate pairs of their
    prefix elements; larger ones scan the inverted lists of theirs, in an order that puts frequent elements
    last; the boundary is the one of least cost. Their sizes say how many prefix elements two sets that link
    share at least; pairs with fewer need no test. Lists of up to 16 sets give all their pairs; longer ones
    first give a star and a chain, and once these have been tested, the sets of a list that still lie in
    different components are compared in blocks. No list is cut, no pair sampled: components are exact.

    Nulls: a null or blank text has an empty set and links with nothing, as does a row without an id; its
    component is its own id. Fewer than five words form one shingle. Repeated rows fall in one class. An
    empty table gives an empty result; other columns are ignored.
    Returns doc_id, n_shingles, component_id.
    """
    docs = docs.selectExpr(f"cast({doc_id} as long) as doc_id", f"{text} as text")
    buckets = partitions_for(total_bytes(docs, "text"), BUCKET_BYTES, 8)
    hot, small_sizes, list_length = frequent_elements(docs, buckets)
    maybe_hot = docs.sparkSession.sparkContext.broadcast(hot)
    light = light_boundary(small_sizes, list_length)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = maybe_hot.value
        maybe = _filter(hot)
        seen: set[int] = set()
        sigs, keys, sizes, held, told = [], [], [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal sigs, keys, sizes, held, told
            rows = []
            if sigs:
                each = np.array([len(x) for x in sigs])
                sig = np.concatenate(sigs)
                rows = [(i, *x) for i, x in _dealt(buckets, sig, sig, np.repeat(np.array(keys, np.int64), each), np.repeat(np.array(sizes, np.int32), each))]
            if told:
                ids, own, n = (np.array([x[i] for x in told], np.int64) for i in range(3))
                rows += [(-1 - i, *x) for i, x in _dealt(buckets, own.view(np.uint64), own, ids, n.astype(np.int32))]
            sigs, keys, sizes, held, told = [], [], [], 0, []
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3)]], ["bucket", "sigs", "keys", "sizes"])

        for ids, sets in _sets(batches):
            for doc, u in zip(ids, sets):
                n, key = len(u), set_key(u)
                if doc is None:
                    continue
                told.append((doc, key, n))
                if n < 3 or key in seen:
                    continue
                seen.add(key)
                out = []
                if n <= light:
                    p = prefix(u, n - least_overlap(n) + 2, hot, maybe)
                    i, j = np.triu_indices(len(p), 1)
                    low, high = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                    out.append(mix(low * _ODD + high) | np.uint64(1))
                if n > light or n >= least_overlap(light + 1):
                    out.append(prefix(u, n - least_overlap(n) + int(matches_for(n)), hot, maybe) & ~np.uint64(1))
                sig = np.concatenate(out)
                sigs.append(sig)
                keys.append(key)
                sizes.append(n)
                held += len(sig)
            if held > 1_500_000:
                yield flush()
        if sigs or told:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
        empty = _out(DOCS, *[np.zeros(0)] * 4)
        if table.column("bucket")[0].as_py() < 0:
            return _out(DOCS, whole("keys", np.int64), whole("sigs", np.int64), whole("sizes", np.int32), np.zeros(sum(len(x.as_buffer()) for x in table.column("keys")) // 8))
        return pa.concat_tables([empty, *_list_pairs(whole("sigs", np.uint64), whole("keys", np.int64), whole("sizes", np.int32), light)])

    blobs = map_batches(docs, signatures, "bucket int, sigs binary, keys binary, sizes binary")
    met = materialize(blobs.groupBy("bucket").applyInArrow(meet, _OUT), "jaccard-meetings")
    told = met.where(F.col("kind") == DOCS).select(F.col("a").alias("doc_id"), F.col("b").alias("key"), "n")
    classes = materialize(told.groupBy("key").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    counted = met.where(F.col("kind") == PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    stars = met.where(F.col("kind") == STARS).select("a", "b")
    long = met.where(F.col("kind") == LONG).select(F.col("a").alias("sig"), F.col("b").alias("key"), "n")
    pairs = materialize(counted.where("n >= need").select("a", "b").union(stars).distinct(), "jaccard-candidates")
    links = verify(pairs, classes, docs, buckets)
    labels = materialize(components(links), "jaccard-labels")
    marked = long.join(labels.toDF("key", "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = marked.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("sig")
    open_lists = materialize(marked.join(several, "sig").select("sig", "key", "n", "label"), "jaccard-open")
    if not open_lists.isEmpty():
        more = cross_links(open_lists, met.where(F.col("kind") == PAIRS).select("a", "b", "n"), pairs, classes, docs, light, buckets)
        labels = materialize(components(links.union(more)), "jaccard-labels")
    discard(pairs, open_lists)
    owner = classes.join(labels.toDF("key", "label"), "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    smallest = owner.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = materialize(owner.join(smallest, "label").select("key", "component_id"), "jaccard-components")
    linked = told.where("n > 0").join(final, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = told.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    unnamed = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).union(unnamed)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the smallest of their component (rows without an id stay)."""
    groups = near_duplicates(docs, doc_id, text)
    gone = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "jaccard-gone")
    return docs.join(gone, doc_id, "left_anti")
