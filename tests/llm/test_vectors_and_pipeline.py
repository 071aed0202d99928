import numpy as np

import corpus_pipeline
from tidegraph.llm import embedding_dedup
from tidegraph.llm.components import components


def test_components_of_a_chain_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    x = np.concatenate([centres[r.integers(0, 40, 500)] + 0.12 * r.normal(size=(500, 16)), np.repeat(centres[:1], 30, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None] * 8), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, [1.0, 2.0]), (None, rows[0][1]), (1006, [])]
    got = {y.vec_id: y for y in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    near[np.arange(len(x)), np.arange(len(x))] = False
    want = near.sum(1)
    assert sum(got[i].n_links for i in range(1, len(x))) >= 0.9 * want.sum() and all(got[i].n_links <= want[i] + 1 for i in range(len(x)))
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) >= 0.95
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_in_a_dense_group_are_found(spark):
    r = np.random.default_rng(8)
    d, n, pairs = 64, 3000, 150
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    side = r.normal(size=(n, d))
    side[:, 0] = 0
    x = np.zeros((n, d))
    x[:, 0] = np.sqrt(0.9)
    x += np.sqrt(0.1) * unit(side)
    y = unit(x[:pairs] + 0.29 * unit(r.normal(size=(pairs, d))))
    all_ = np.concatenate((x, y))
    near = unit(all_) @ unit(all_).T >= 0.95
    np.fill_diagonal(near, False)
    got = {z.vec_id: z for z in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>")).collect()}
    found, want = np.array([got[i].n_links for i in range(len(all_))]), near.sum(1)
    assert want.sum() >= pairs and (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_stages_keep_the_columns_and_clean_documents(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, words(i, 80), "en", f"s{i % 2}", 1) for i in range(20)] + [(50, words(0, 80), "en", "s0", 1), (51, words(1, 79) + " end", "en", "s1", 1), (52, words(90, 30) + " " + words(2, 80) + " " + words(91, 30), "en", "s0", 1), (53, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert one.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in one.collect()} == {*range(20), 52, 53}
    cut = corpus_pipeline.cut_repeats(spark, one, "")
    by = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == corpus_pipeline.COLUMNS and "w2x40" not in by[52] and by[2] == words(2, 80) and by[53] is None
    mixed = corpus_pipeline.mix(spark, cut, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(by)
    assert corpus_pipeline.encode_pieces(spark, mixed, "").count() == mixed.count()
