"""Admission by time, idempotency, token buckets, cap control, audit chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64
# fixed values: fan-out cap and expansion budget of each rung; target and loosening bound of the p95 in ms
LADDER = [(512, 1500), (384, 1000), (256, 750), (128, 500), (64, 250)]
TARGET_MS, LOOSEN_MS, LEAST_SAMPLES, RING = 100.0, 50.0, 16, 64


def admitted(mutations: DataFrame, arrival: str = "arrival", ts: str = "ts", mark: int = 0, lane: str | None = None) -> DataFrame:
    """Rows marked ``ok`` where their time is past every earlier arrival's; late rows are rejected, not buffered.

    A rejected row never moves the high-water mark, so a running maximum is exact. ``lane`` orders each
    partition of the input on its own; without one the whole stream has one order, as its contract asks.
    """
    w = Window.partitionBy(*([lane] if lane else [])).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return mutations.withColumn("ok", F.col(ts) > F.greatest(F.coalesce(F.max(ts).over(w), F.lit(mark)), F.lit(mark)))


def first_requests(requests: DataFrame, request: str = "request_id", created: str = "created_us", ttl_us: int = 24 * 3600 * 1_000_000, id: str | None = None) -> DataFrame:
    """Rows with ``replayed``: a request no older than the time to live after its stored outcome is not run again.

    One that runs stores its outcome anew, so each request is a fold in order of ``created`` (then ``id``).
    Requests with a single row, or all within one time to live of their first, need no fold.
    """
    order = [created, *([id] if id else [])]
    w = Window.partitionBy(request)
    first, age = F.min(created).over(w), F.max(created).over(w) - F.min(created).over(w)
    marked = requests.withColumns({"_rank": F.row_number().over(w.orderBy(*order)), "_age": age, "_first": first})
    short = marked.where(F.col("_age") <= ttl_us).withColumn("replayed", F.col("_rank") > 1).drop("_rank", "_age", "_first")
    schema = T.StructType([*requests.schema.fields, T.StructField("replayed", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, stored, out = pdf.sort_values(order), None, []
        for at in pdf[created]:
            out.append(stored is not None and at - stored <= ttl_us)
            stored = stored if out[-1] else at
        return pdf.assign(replayed=out)

    long = marked.where(F.col("_age") > ttl_us).drop("_rank", "_age", "_first").groupBy(request).applyInPandas(run, schema)
    return short.union(long)


def conflicts(reads: DataFrame, commits: DataFrame) -> DataFrame:
    """Requests (request, node, since) whose read set meets a commit (src, dst, seq) after their position."""
    ends = commits.select(F.explode(F.array("src", "dst")).alias("node"), "seq")
    return reads.join(ends, "node").where("seq > since").select("request").distinct()


def _fold(df: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(run, schema)


def token_bucket(calls: DataFrame, rate: float, burst: float) -> DataFrame:
    """Each principal's calls (principal, id, at_s) in time order: a call passes where a token is left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at_s", "id"])
        tokens, last, out = max(burst, 1.0), None, []
        for at in pdf.at_s:
            tokens = min(max(burst, 1.0), tokens + (0 if last is None else at - last) * rate)
            last = at
            out.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        return pdf.assign(allowed=out)[["principal", "id", "at_s", "allowed"]]

    return _fold(calls.select("principal", "id", "at_s"), "principal", run, "principal string, id long, at_s double, allowed boolean")


def nearest_rank(values: list[float], q: float) -> float:
    ordered = sorted(values)
    return ordered[max(0, -(-int(q * 100 * len(ordered)) // 100) - 1)]


def cap_controller(samples: DataFrame) -> DataFrame:
    """Each stream's durations (stream, id, ms) in order: the rung after each; a move empties the window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rung, window, out = pdf.sort_values("id"), 0, [], []
        for ms in pdf.ms:
            window = [*window, ms][-RING:]
            if len(window) >= LEAST_SAMPLES:
                p95 = nearest_rank(window, 0.95)
                if p95 > TARGET_MS and rung + 1 < len(LADDER):
                    rung, window = rung + 1, []
                elif p95 <= LOOSEN_MS and rung > 0:
                    rung, window = rung - 1, []
            out.append(rung)
        return pdf.assign(rung=out, cap=[LADDER[r][0] for r in out])[["stream", "id", "ms", "rung", "cap"]]

    return _fold(samples.select("stream", "id", "ms"), "stream", run, "stream string, id long, ms double, rung int, cap int")


def audit_hash(columns: list[str], domain: str = "tidegraph-audit-v1"):
    """SHA-256 over a domain prefix and the record as JSON, its fields in the given order and the hash left out."""
    return F.sha2(F.concat(F.lit(domain), F.to_json(F.struct(*columns))), 256)


def audit_failures(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records that break a chain: a wrong hash, a wrong link to the one before, or a gap in the numbers."""
    w = Window.partitionBy("chain").orderBy("seq")
    r = records.withColumns({"_prev": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)), "_seq": F.lag("seq").over(w)})
    return r.where((F.col("hash") != audit_hash(columns)) | (F.col("prev_hash") != F.col("_prev")) | (F.col("seq") != F.coalesce(F.col("_seq") + 1, F.lit(1)))).drop("_prev", "_seq")


def append_audit(records: DataFrame, columns: list[str], domain: str = "tidegraph-audit-v1") -> DataFrame:
    """Link each chain's records (without hashes) in order of seq; a fold, since every hash needs the one before."""
    import hashlib
    import json

    schema = T.StructType([*records.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, prevs, hashes = pdf.sort_values("seq"), GENESIS, [], []
        for row in pdf.to_dict("records"):
            body = json.dumps({c: last if c == "prev_hash" else row[c] for c in columns}, separators=(",", ":"), ensure_ascii=False)
            prevs.append(last)
            last = hashlib.sha256((domain + body).encode()).hexdigest()
            hashes.append(last)
        return pdf.assign(prev_hash=prevs, hash=hashes)

    return records.groupBy("chain").applyInPandas(run, schema)


def missing_sequences(applied: DataFrame, key: str = "replica") -> DataFrame:
    """Gaps in each replica's applied sequence numbers: the last before and the first after."""
    w = Window.partitionBy(key).orderBy("seq")
    return applied.select(key, F.lag("seq").over(w).alias("after"), F.col("seq").alias("before")).where("before > after + 1")


def ingest_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of mutations into ``sink(batch, id)`` in micro-batches; the sink sees each batch id once it is whole."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def deduplicated_stream(stream: DataFrame, request: str = "request_id", time: str = "created", ttl: str = "24 hours") -> DataFrame:
    """Drops repeats of a request while its first is younger than the time to live."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([request])


def strict_stream(stream: DataFrame, key: str = "lane", arrival: str = "arrival", ts: str = "ts") -> DataFrame:
    """Admission over a stream: each lane's high-water mark is kept as state between micro-batches."""

    def run(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else 0
        for pdf in pdfs:
            pdf, ok = pdf.sort_values(arrival), []
            for t in pdf[ts]:
                ok.append(bool(t > mark))
                mark = max(mark, int(t))
            yield pdf.assign(ok=ok)
        state.update((mark,))

    schema = T.StructType([*stream.schema.fields, T.StructField("ok", T.BooleanType())])
    return stream.groupBy(key).applyInPandasWithState(run, schema, "mark long", "append", "NoTimeout")
