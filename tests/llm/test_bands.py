import numpy as np

from tidegraph.llm import substring_dedup as sd

LEAST, NEED = 46, 40


def test_band_filter_loses_no_stretch_and_spares_runs_that_cannot_link():
    r = np.random.default_rng(4)
    rows = [np.array([1] * 41 + [0, 6, 5, 3, 2]), np.array([1] * 44 + [7, 4])]
    for _ in range(60):
        base = r.integers(0, r.choice([2, 8, 400]), int(r.integers(46, 92)))
        rows.append(base)
        for _ in range(2):
            other = base.copy()
            other[r.random(len(other)) < r.choice([0.02, 0.1, 0.2])] = r.integers(400, 500)
            rows.append(np.roll(other, int(r.integers(0, 30)))[: int(r.integers(40, 92))])
    codes = sd.coded([x.astype(np.uint32) for x in rows])
    linked = passed = 0
    for x in range(len(rows)):
        own = codes[x][: len(rows[x])]
        kept = sd.share_a_band(own, codes, LEAST, NEED)
        truth = np.array([bool(sd.matching_stretches(own, codes[y][: len(rows[y])], LEAST)) for y in range(len(rows))])
        assert kept[truth].all()
        linked, passed = linked + truth.sum(), passed + kept.sum()
    assert linked > len(rows) and passed < 1.5 * linked
    assert not sd.share_a_band(codes[0][:46], codes[1:2], LEAST, NEED)[0]


def test_contexts_that_cannot_link_are_not_verified(monkeypatch):
    asked = []
    monkeypatch.setattr(sd, "matching_stretches", lambda x, y, least, f=sd.matching_stretches: asked.append(1) or f(x, y, least))
    tokens = [np.array([1] * (41 + i % 3) + list(range(10 * i + 5, 10 * i + 10 - i % 3)), np.uint32) for i in range(20)]
    ids = np.arange(20)
    assert sd.context_links(ids, ids, np.zeros(20, bool), np.zeros(20, np.int64), tokens, LEAST) == [] and not asked
