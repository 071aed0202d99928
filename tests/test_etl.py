import json

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import etl, ranks
from tidegraph.schema import EDGE_TYPES, NAMESPACES, InvalidRequest

DRUGS = ["metformin", "insulin", "acarbose"]
COLUMNS = ["encounter_id", "patient_nbr", "race", "gender", "diag_1", "diag_2", "diag_3", "medical_specialty", "max_glu_serum", "A1Cresult", "readmitted", *DRUGS]
ROWS = [
    (70, "p2", "A", "F", "250.1", "?", "V45", "Cardio", "None", ">8", "NO", "Steady", "No", "Up"),
    (10, "p1", "?", "M", "401", "250.1", None, "?", ">200", "None", "<30", "Steady", "Up", "No"),
    (30, "p1", "B", "M", "401", "E10", "", "Cardio", "None", "None", "NO", "No", "Down", "No"),
    (20, "p2", " ", "F", "8", "8", "8", "Unknown/Invalid", "None", "Norm", ">30", "No", "No", "No"),
    (50, "p3", "A", "Unknown/Invalid", "401", "?", "?", "Derma", "Norm", ">8", "NO", "Up", "Steady", "Steady"),
    (60, "p3", "A", "F", "?", "?", "?", "NULL", "None", "None", "NO", "No", "No", "No"),
    (80, "p3", "A", "F", "V45", "?", "?", "Derma", "None", "None", "NO", "No", "Steady", "No"),
    (40, "p1", "B", "M", "12", "E10", "9", "Derma", "None", "None", "NO", "No", "No", "Steady"),
    (90, "p4", "C", "F", "1", "2", "3", "X", "None", "None", "NO", "No", "No", "No"),
    (100, "p4", "C", "F", "3", "2", "1", "X", "None", "None", "NO", "Down", "No", "No"),
    (110, "p1", "B", "M", "401", "?", "?", "Cardio", "None", "None", "NO", "No", "No", "No"),
    (120, "p2", "A", "F", "?", "?", "?", "?", "None", "None", "NO", "No", "No", "Up"),
]
BASE, STEP = 1000, 100


def by_hand(rows):
    """Edges and ids as one pass over the ordered rows gives them."""
    missing = ("?", "", "None", "NULL", "Unknown/Invalid")
    there = lambda x: x is not None and x.strip() not in missing
    ids, last, edges = {}, {}, []

    def number(kind, key):
        own = ids.setdefault(kind, {})
        return own.setdefault(key, NAMESPACES[kind] + len(own))

    for rank, values in enumerate(sorted(rows)):
        r, ts = dict(zip(COLUMNS, values)), BASE + rank * STEP
        p, out = number("Patient", r["patient_nbr"]), []
        out.append((6, number("Encounter", str(r["encounter_id"])), False))
        out += [(1, number("Condition", r[c]), False) for c in ("diag_1", "diag_2", "diag_3") if there(r[c])]
        out += [(4, number("Provider", r["medical_specialty"]), False)] if there(r["medical_specialty"]) else []
        out += [(5, number("LabResult", f"{c}={r[c]}"), False) for c in ("max_glu_serum", "A1Cresult") if there(r[c])]
        taken = [c for c in DRUGS if r[c] in ("Steady", "Up", "Down")]
        out += [(2, number("Medication", c), False) for c in taken]
        out += [(2, number("Medication", c), True) for c in sorted(set(last.get(p, [])) - set(taken))]
        last[p] = taken
        edges += [(p, kind, dst, ts + i + 1, gone) for i, (kind, dst, gone) in enumerate(out)]
    return ids, edges


def test_twelve_encounters_become_nodes_edges_and_tombstones(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    nodes, edges = (x.collect() for x in etl.emit(df, DRUGS, BASE, STEP))
    ids, want = by_hand(ROWS)
    assert sorted((r.src, r.edge_type, r.dst, r.ts, r.deleted) for r in edges) == sorted(want)
    assert {r.edge_type for r in edges} <= set(EDGE_TYPES) and any(r.deleted for r in edges)
    assert {(r.node_type, r.node_id) for r in nodes} == {(k, i) for k, own in ids.items() for i in own.values()} and len(nodes) == sum(map(len, ids.values()))
    told = {r.node_id: r for r in nodes}
    first = told[ids["Patient"]["p1"]]
    assert json.loads(first.properties) == {"gender": "M"} and first.encrypted == ["gender"] and first.ts == BASE
    lab = told[ids["LabResult"]["A1Cresult=>8"]]
    assert (json.loads(lab.properties), lab.ts) == ({"assay": "A1Cresult", "result": ">8"}, BASE)
    assert json.loads(told[ids["Encounter"]["10"]].properties) == {"readmitted": "<30"}
    assert {json.loads(r.properties)["position"] for r in edges if r.edge_type == 1} == {"diag_1", "diag_2", "diag_3"}


def test_patients_are_chosen_after_time_is_given(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    _, edges = etl.emit(df, DRUGS, BASE, STEP, patients=2)
    want = sorted(BASE + i * STEP + 1 for i, r in enumerate(sorted(ROWS)) if r[1] in ("p1", "p2"))
    assert sorted(r.ts for r in edges.where("edge_type = 6").collect()) == want


def test_full_namespaces_and_empty_tables_raise(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    with pytest.raises(InvalidRequest):
        etl.emit(df, DRUGS, BASE, STEP, room={"Condition": 3})
    with pytest.raises(InvalidRequest):
        etl.emit(df.limit(0), DRUGS, BASE, STEP)
    with pytest.raises(InvalidRequest):
        etl.dense_ids(df, "diag_1", "encounter_id", "Condition", room=2)


def test_global_ranks_equal_sorted_places(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("x")).repartition(5)
    got = {r.x: r["rank"] for r in ranks.global_rank(df, ["x"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got))}


def test_an_empty_room_lets_a_namespace_grow_without_end(spark):
    rows = [(i, f"p{i}", "A", "F", "1", "?", "?", "?", "None", "None", "NO", "No", "No", "No") for i in range(5)]
    df = spark.createDataFrame(rows, COLUMNS)
    with pytest.raises(InvalidRequest):
        etl.emit(df, DRUGS, BASE, STEP, room={"Patient": 3})
    many = spark.range(100_005).select(F.col("id").alias("encounter_id"), F.col("id").cast("string").alias("patient_nbr"), *[F.lit("?").alias(c) for c in COLUMNS[2:]])
    nodes, edges = etl.emit(many, DRUGS, BASE, STEP, room={})
    assert nodes.where("node_type = 'Patient'").agg(F.max("node_id")).first()[0] == 100_005 and edges.count() == 100_005
