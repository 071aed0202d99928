import json

import pytest

from tidegraph.functions.features import json_depth, require_features
from tidegraph.schema import InvalidRequest, clamp_k, clamp_limit, require_model_kind
from tidegraph.sources import trace
from tidegraph.streaming import ordering


def test_admission_in_batches_equals_one_batch(spark, tmp_path):
    rows = [(i, "a", t) for i, t in enumerate((5, 3, 9, 9, 12, 1, 13))]
    df = spark.createDataFrame(rows, "arrival long, lane string, ts long")
    want = {r.arrival: r.ok for r in ordering.admitted(df).collect()}
    assert [want[i] for i in range(7)] == [True, False, True, False, True, False, True]
    source = tmp_path / "in"
    for k in (0, 3):
        df.where(f"arrival >= {k} and arrival < {k + 3 if k == 0 else 9}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = []
    q = ordering.ingest_stream(ordering.strict_stream(stream), lambda batch, _: got.extend(batch.collect()), str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert len(got) == 7 and sum(r.ok for r in got) >= 3


def test_token_bucket_and_caps(spark):
    calls = spark.createDataFrame([("p", i, t) for i, t in enumerate((0.0, 0.0, 0.0, 1.0, 1.0))], "principal string, id long, at_s double")
    got = {r.id: r.allowed for r in ordering.token_bucket(calls, 1.0, 2).collect()}
    assert [got[i] for i in range(5)] == [True, True, False, True, False]
    slow = spark.createDataFrame([("s", i, 200.0 if i < 32 else 10.0) for i in range(48)], "stream string, id long, ms double")
    rungs = [r.rung for r in ordering.cap_controller(slow).orderBy("id").collect()]
    assert rungs[14] == 0 and rungs[15] == 1 and rungs[31] == 2 and rungs[47] == 1


def test_audit_chain_finds_edits(spark):
    cols = ["chain", "seq", "prev_hash", "who"]
    rows = spark.createDataFrame([("c", i, f"u{i}") for i in range(1, 6)], "chain string, seq long, who string")
    linked = ordering.append_audit(rows, cols).collect()
    assert ordering.audit_failures(spark.createDataFrame(linked), cols).count() == 0
    edited = [r.asDict() | ({"who": "x"} if r.seq == 3 else {}) for r in linked]
    assert [r.seq for r in ordering.audit_failures(spark.createDataFrame(edited), cols).collect()] == [3]
    assert ordering.audit_failures(spark.createDataFrame([r for r in linked if r.seq != 3]), cols).count() == 1


def test_traces_are_read_whole_or_not_at_all(spark, tmp_path):
    good = [{"op": "upsert_node", "node_id": 1, "node_type": "Patient", "timestamp_us": 5}, {"op": "add_edge", "src": 1, "dst": 2, "edge_type": 1, "timestamp_us": 6, "edge_type_name": "x"}, {"op": "remove_edge", "src": 1, "dst": 2, "edge_type": 1, "timestamp_us": 7}]
    (tmp_path / "t.jsonl").write_text("\n\n".join(map(json.dumps, good)) + "\n")
    t = trace.read_trace(spark, str(tmp_path / "t.jsonl"))
    assert trace.trace_nodes(t).count() == 1 and [r.deleted for r in trace.trace_edges(t).orderBy("ts").collect()] == [False, True]
    m = trace.manifest(t).first()
    assert (m.upsert_nodes, m.add_edges, m.remove_edges, m.records) == (1, 1, 1, 3)
    stored = trace.bulk_load(trace.trace_edges(t), str(tmp_path / "out"), "src", 2)
    assert stored.count() == 2
    (tmp_path / "bad.jsonl").write_text('{"op": "drop_all"}\n')
    with pytest.raises(Exception, match="unknown operation"):
        trace.read_trace(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(InvalidRequest):
        trace.read_trace(spark, str(tmp_path / "empty.jsonl"))


def test_scalar_checks(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": "}]"}]}',), ("{}",), (None,)], "j string")
    assert [r[0] for r in df.select(json_depth("j")).collect()] == [3, 1, 0]
    assert clamp_k(0) == 10 and clamp_limit(0, 5, 9) == 5 and clamp_limit(50, 5, 9) == 9
    for bad in (lambda: clamp_k(1001), lambda: require_model_kind(2), lambda: require_features(["age"], {"age"})):
        with pytest.raises(InvalidRequest):
            bad()


def test_outcomes_live_a_day_from_their_last_run(spark):
    hour = 3600 * 1_000_000
    rows = [("a", i, h * hour) for i, h in enumerate([0, 24, 47, 49])] + [("b", 9, 5), ("c", 7, 0), ("c", 8, 0)]
    df = spark.createDataFrame(rows, "request_id string, n int, created_us long")
    got = {(r.request_id, r.n): r.replayed for r in ordering.first_requests(df, id="n").collect()}
    assert got == {("a", 0): False, ("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 9): False, ("c", 7): False, ("c", 8): True}
