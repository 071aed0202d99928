import random

from tidegraph.operators import temporal


def model(rows, t):
    state = {}
    for src, et, dst, ts, seq, deleted in sorted(rows, key=lambda r: (r[3], r[4])):
        if ts <= t:
            state[(src, et, dst)] = (ts, seq, deleted)
    return {k: v[:2] for k, v in state.items() if not v[2]}


SCHEMA = "src long, edge_type int, dst long, ts long, seq long, deleted boolean"


def random_rows(seed, n=120):
    r = random.Random(seed)
    return [(r.randint(1, 3), r.randint(1, 2), r.randint(1, 6), r.randint(1, 40), i, r.random() < 0.3) for i in range(n)]


def test_as_of_equals_a_plain_model_at_every_time(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, SCHEMA).cache()
        for t in (0, 1, 7, 20, 33, 40, 41):
            want = model(rows, t)
            got = {(r.src, r.edge_type, r.dst): (r.ts, r.seq) for r in temporal.as_of(df, temporal.EDGE_KEY, t).collect()}
            assert got == want
            got = {(r.src, r.edge_type, r.dst): (r.ts, r.seq) for r in temporal.newest_by_max(df, temporal.EDGE_KEY, t).where("not deleted").collect()}
            assert got == want


def test_tombstones_do_not_bring_back_older_versions(spark):
    df = spark.createDataFrame([(1, 1, 9, 10, 1, False), (1, 1, 9, 20, 2, True), (1, 1, 9, 30, 3, False)], SCHEMA)
    assert [temporal.as_of(df, temporal.EDGE_KEY, t).count() for t in (9, 10, 20, 29, 30)] == [0, 1, 0, 0, 1]


def test_batch_reads_equal_single_reads(spark):
    rows = random_rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    requests = [(s, e, d, t) for s in (1, 2) for e in (1, 2) for d in (1, 4) for t in (0, 13, 40)]
    q = spark.createDataFrame([(*r, i) for i, r in enumerate(requests)], "src long, edge_type int, dst long, t long, id long")
    got = {r.id: None if r.ts is None else (r.ts, r.seq, r.deleted) for r in temporal.as_of_batch(df, temporal.EDGE_KEY, q).collect()}
    for i, (s, e, d, t) in enumerate(requests):
        own = sorted(((r[3], r[4], r[5]) for r in rows if r[:3] == (s, e, d) and r[3] <= t))
        assert got[i] == (own[-1] if own else None)


def test_last_write_wins_and_windows(spark):
    df = spark.createDataFrame([(1, 1, 9, 10, 1, False), (1, 1, 9, 10, 2, True), (1, 1, 9, 11, 3, False)], SCHEMA)
    assert sorted((r.ts, r.seq) for r in temporal.last_write_wins(df, temporal.EDGE_KEY).collect()) == [(10, 2), (11, 3)]
    assert temporal.versions_between(df, 10, 11).count() == 3
    assert temporal.versions_between(df, 11, 10).count() == 0


def test_limits_count_live_edges_only(spark):
    rows = [(1, 1, d, 100 + d, d, d == 6) for d in range(1, 7)]
    live = temporal.as_of(spark.createDataFrame(rows, SCHEMA), temporal.EDGE_KEY, 1000)
    assert sorted(r.dst for r in temporal.adjacency_limited(live, 2).collect()) == [4, 5]


def test_ids_of_two_kinds_at_one_time_give_the_kind_of_their_namespace(spark, tmp_path):
    from tidegraph.plans import queries

    keys = {"customer": ("c_custkey", [4, 99_999, 199_999, 400_006]), "nation": ("n_nationkey", [0]), "part": ("p_partkey", [0, 200_000, 200_007]), "supplier": ("s_suppkey", [0, 7]), "region": ("r_regionkey", [0])}
    for name, (column, values) in keys.items():
        spark.createDataFrame([(v,) for v in values], f"{column} long").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.sql("select 1L o_orderkey, timestamp_ntz '1990-01-01 00:00:00' o_orderdate, 'O' o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.node_id, r.node_type) for r in queries.t01_node_as_of(spark, str(tmp_path)).collect()}
    assert got == {(5, "Patient"), (100_000, "Condition"), (200_000, "Medication"), (400_000, "Provider"), (400_007, "Provider"), (500_000, "LabResult"), (600_001, "Encounter")}
