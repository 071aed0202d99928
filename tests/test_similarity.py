import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegraph.operators import similarity
from tidegraph.operators.temporal import newest

SCHEMA = "node_id long, ts long, seq long, vector array<float>, model_id string"


def odd_versions(spark):
    r = random.Random(3)
    rows = []
    for i in range(90):
        vector = [round(r.uniform(-1, 1), 1) for _ in range(r.choice((3, 3, 3, 2)))]
        vector = {5: None, 6: [0.0, 0.0, 0.0], 7: [1.0, None, 2.0], 8: [float("nan"), 1.0, 0.0], 9: []}.get(i, vector)
        rows.append((i, 10 if i % 7 else 20, 0, vector, f"m{i % 3}" if i % 11 else None))
        if i % 4 == 0:
            rows.append((i, 20, 1, [r.uniform(-1, 1) for _ in range(3)], f"m{r.randint(0, 2)}"))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(similarity, "CANDIDATES", 8)
    monkeypatch.setattr(similarity, "QUERIES", 4)


def test_blocks_give_the_same_nearest_as_all_pairs(spark, small_blocks):
    v = odd_versions(spark)
    queries = v.where("node_id % 3 = 0 or node_id between 5 and 9").select("node_id").distinct()
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    want = similarity.scores(v, queries, 20).withColumn("place", F.row_number().over(w)).where("place <= 4")
    got = similarity.top_similar(v, queries, 20, 4)
    assert "CartesianProduct" in got._jdf.queryExecution().toString() or "BroadcastNestedLoopJoin" in got._jdf.queryExecution().toString()
    assert rows_of(got.select(*want.columns)) == rows_of(want)


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_blocks_give_the_same_changes_as_all_pairs(spark, small_blocks, least):
    v = odd_versions(spark)
    queries = v.where("node_id % 2 = 0").select("node_id").distinct()
    a, b = (similarity.scores(v, queries, t).withColumnRenamed("score", n) for t, n in ((10, "before"), (20, "after")))
    known = newest(v, ["node_id"], 10).select("node_id").intersect(newest(v, ["node_id"], 20).select("node_id")).withColumnRenamed("node_id", "query")
    j = a.join(b, ["query", "node"], "full").join(known, "query", "left_semi").withColumn("two_sided", F.expr("before is not null and after is not null"))
    j = j.withColumn("delta", F.when(F.col("two_sided"), F.round(F.col("after") - F.col("before"), 6)).otherwise(0.0)).where(~F.col("two_sided") | (F.abs("delta") >= least))
    j = j.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.abs("delta").desc(), "node"))).where("place <= 5").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("before", "after")})
    got = similarity.similarity_delta(v, queries, 10, 20, least, 5)
    assert rows_of(got) == rows_of(j.select(*got.columns))
