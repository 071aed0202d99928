import random

import numpy as np

from tidegraph.operators import embedding, graph, temporal

SCHEMA = "src long, edge_type int, dst long, ts long, seq long, deleted boolean"
CARE = [(1, 1, 100001, 110, 1, False), (2, 1, 100001, 120, 2, False), (1, 2, 200001, 130, 3, False), (3, 1, 100002, 140, 4, False), (1, 1, 100001, 200, 5, True)]


def live(spark, rows, t):
    return temporal.as_of(spark.createDataFrame(rows, SCHEMA), temporal.EDGE_KEY, t)


def test_two_hops_before_and_after_a_retraction(spark):
    assert 2 in dict(graph.traverse_exact(live(spark, CARE, 150), 1, 2).nodes)
    assert 2 not in dict(graph.traverse_exact(live(spark, CARE, 250), 1, 2).nodes)
    starts = spark.createDataFrame([(0, 1)], "request int, node long")
    got = {(r.node, r.hops) for r in graph.traverse_set(live(spark, CARE, 150), starts, 2).collect()}
    assert got == set(graph.traverse_exact(live(spark, CARE, 150), 1, 2).nodes)


def test_unknown_start_returns_itself(spark):
    r = graph.traverse_exact(live(spark, CARE, 150), 77, 3)
    assert r.nodes == [(77, 0)] and r.edges == []


def test_hub_survivors_are_the_newest_less_the_highest_id(spark):
    rows = [(i, 1, 100001, 110 + i, i, False) for i in range(1, 51)]
    r = graph.traverse_exact(live(spark, rows, 1000), 100001, 1, cap=10)
    assert sorted(n for n, h in r.nodes if h) == list(range(40, 50))
    assert r.truncation["fanout_capped_nodes"] == 1 and len(r.edges) == 10
    old = graph.traverse_exact(live(spark, rows, 1000), 100001, 1, cap=10, window=(1, 120))
    assert old.edges == []


def test_node_budget_keeps_the_edge_that_met_it(spark):
    r = graph.traverse_exact(live(spark, CARE, 150), 1, 2, max_nodes=1)
    assert len(r.nodes) == 1 and len(r.edges) == 1 and r.truncation["node_limit"]


def test_random_graphs_equal_breadth_first_search(spark):
    r = random.Random(5)
    rows = [(r.randint(1, 15), r.randint(1, 3), r.randint(16, 30), i, i, False) for i in range(40)]
    edges = live(spark, rows, 100).cache()
    near = {}
    for s, _, d, *_ in rows:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    want, frontier = {rows[0][0]: 0}, [rows[0][0]]
    for hop in (1, 2, 3):
        frontier = [b for a in frontier for b in near.get(a, ()) if b not in want and not want.update({b: hop})]
    assert dict(graph.traverse_exact(edges, rows[0][0], 3).nodes) == want
    starts = spark.createDataFrame([(0, rows[0][0])], "request int, node long")
    assert {x.node: x.hops for x in graph.traverse_set(edges, starts, 3).collect()} == want


def test_snapshot_keeps_dangling_targets_and_needs_a_live_subject(spark):
    nodes = spark.createDataFrame([(1, "Patient"), (200001, "Medication")], "node_id long, node_type string")
    subjects = spark.createDataFrame([(1,), (3,)], "node_id long")
    got = {(r.src, r.dst, r.target_type) for r in graph.snapshot(live(spark, CARE, 150), nodes, subjects).collect()}
    assert got == {(1, 100001, None), (1, 200001, "Medication")}


def test_incremental_vectors_equal_full_ones(spark):
    r = random.Random(7)
    rows = [(1 + i, 1, 100000, 1 + i, i, False) for i in range(12)] + [(r.randint(1, 12), 2, 200000 + r.randint(0, 2), 50 + i, 50 + i, False) for i in range(12)]
    edges = live(spark, rows, 1000)
    nodes = sorted({x for row in rows for x in (row[0], row[2])})
    x = {n: [float(n % 3 == i) for i in range(3)] for n in nodes}
    features = spark.createDataFrame([(n, v) for n, v in x.items()], "node long, x array<double>")
    targets = spark.createDataFrame([(0, n) for n in nodes[:4]], "request long, node long")
    place = {n: i for i, n in enumerate(nodes)}
    pairs = np.array(sorted({(place[min(a, b)], place[max(a, b)]) for a, _, b, *_ in rows}))
    both = np.concatenate((pairs, pairs[:, ::-1]))
    for model in (embedding.SageModel(3), embedding.GatModel(3)):
        full = model.forward(np.array([x[n] for n in nodes]), both)
        part = embedding.receptive_edges(edges, targets)
        for row in embedding.embed_targets(part, features, targets, model).collect():
            assert np.allclose(row.vector, full[place[row.node]], atol=1e-6)


def test_attribution_adds_up(spark):
    r = np.random.default_rng(3)
    x, edges = r.normal(size=(8, 3)), np.array([(a, b) for a in range(8) for b in range(8) if a != b and (a + b) % 3])
    out = embedding.attribution(embedding.SageModel(3), x, edges, 2, steps=64, top=5)
    total = sum(v for *_, v in out["top"]) + out["rest_sum"]
    assert abs(out["residual"]) <= 0.03 * max(abs(total), 0.1) and out["rest_count"] == len(edges) - 5


def test_hub_deferral_loses_nothing(spark):
    rows = [(i, 1, 100000, i, i, False) for i in range(1, 31)] + [(500, 2, 200001, 100, 40, False), (1, 2, 200001, 102, 42, False)]
    edges = live(spark, rows, 1000)
    m = spark.createDataFrame([(0, 500, 100000)], "request long, src long, dst long")
    plain = {r.node for r in embedding.affected(edges, m).collect()}
    split = embedding.affected(edges, m, hub_degree=10).collect()
    now, late = ({r.node for r in split if r.state == s} for s in ("affected", "deferred"))
    assert not now & late and now | late == plain and 100000 in late and 500 in now


def test_without_a_cap_a_traversal_passes_any_hub(spark):
    rows = [(i, 1, 100001, 110 + i, i, False) for i in range(1, 601)]
    starts = spark.createDataFrame([(0, 7)], "request int, node long")
    edges = live(spark, rows, 1000)
    got = {(r.node, r.hops) for r in graph.traverse_set(edges, starts, 2, cap=None).collect()}
    assert got == {(7, 0), (100001, 1)} | {(i, 2) for i in range(1, 601) if i != 7}
    assert graph.traverse_set(edges, starts, 2).count() < len(got)
    assert graph.traverse_set(edges, starts, 1, cap=None, window=(1, 112)).count() == 1


def test_affected_rows_are_told_once_and_pairs_are_not_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CHUNK", 3)
    r = random.Random(9)
    rows = [(r.randint(1, 14), r.randint(1, 3), r.randint(1, 14), i, i, False) for i in range(45)]
    near = {}
    for a, _, b, *_ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [(i, r.randint(1, 16), r.randint(1, 16)) for i in range(40)] + [(3, 2, 5), (3, 7, 9), (4, 1, 1)]
    edges, m = live(spark, rows, 1000), spark.createDataFrame(asked, "request long, src long, dst long")
    for degree in (None, 4):
        hubs = {n for n, o in near.items() if degree and len(o) > degree}
        want = set()
        for request in {x[0] for x in asked}:
            ends = {n for x in asked if x[0] == request for n in x[1:]}
            wide = ends | {o for n in ends - hubs for o in near.get(n, ())}
            late = {o for n in ends & hubs for o in near[n]} | (wide & hubs)
            want |= {(request, n, "affected") for n in wide - hubs} | {(request, n, "deferred") for n in late - (wide - hubs)}
        got = embedding.affected(edges, m, cap=None, hub_degree=degree)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    one = embedding.affected(edges, m.where("request > 4"), cap=None)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in one


def hub_and_requests(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SLICE", 50)
    edges = live(spark, [(i, 1, 100000, i, i, False) for i in range(1, 401)], 1000)
    return edges, spark.createDataFrame([(j, 5000 + j, 100000) for j in range(200)], "request long, src long, dst long")


def test_affected_tells_each_neighbour_with_many_requests_in_a_run(spark, monkeypatch):
    edges, m = hub_and_requests(spark, monkeypatch)
    got = embedding.affected(edges, m, cap=None).collect()
    assert sorted((r.request, r.node) for r in got) == sorted((j, n) for j in range(200) for n in (5000 + j, 100000, *range(1, 401)))
    near = [r.node for r in got if r.node <= 400]
    assert sum(a != b for a, b in zip(near, near[1:])) < len(near) / 10


def test_deferred_neighbours_of_a_hub_are_told_in_runs_too(spark, monkeypatch):
    edges, m = hub_and_requests(spark, monkeypatch)
    got = embedding.affected(edges, m, cap=None, hub_degree=60).collect()
    want = {(j, n, "deferred") for j in range(200) for n in (100000, *range(1, 401))} | {(j, 5000 + j, "affected") for j in range(200)}
    assert sorted(map(tuple, got)) == sorted(want)
    near = [r.node for r in got if r.node <= 400]
    assert sum(a != b for a, b in zip(near, near[1:])) < len(near) / 10
