import numpy as np
import pytest

from tidegraph.llm import substring_dedup as sd


def table(spark, rows):
    return spark.createDataFrame([(r[0], hash((r[0], r[1], n)) % (1 << 40), r[1], 0, r[1], False, bytearray(r[2].tobytes())) for n, r in enumerate(rows)], "list long, h long, doc long, lo long, comp long, settled boolean, tokens binary")


def met(rounds):
    """Pairs of contexts that meet in a block pair, from different blocks or in one, with how often; rows of each round."""
    times, sizes = {}, []
    for dealt in rounds:
        groups = {}
        got = dealt.collect()
        sizes.append(len(got))
        for r in got:
            groups.setdefault((r.list, r.i, r.j), []).append(r)
        for (name, i, j), own in groups.items():
            for x in own:
                for y in own:
                    if x.doc < y.doc and (i == j or x.block != y.block):
                        times[name, x.doc, y.doc] = times.get((name, x.doc, y.doc), 0) + 1
    return times, sizes


def test_contexts_that_cannot_link_in_their_list_are_not_dealt_to_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "CROWD", 20)
    r = np.random.default_rng(1)
    near = r.integers(0, 1 << 32, 91, np.uint32)
    alike = [near[k:91 - k % 3] for k in range(8)]
    rows = [(1, d, r.integers(0, 1 << 32, 80, np.uint32)) for d in range(300)] + [(1, 300 + d, x) for d, x in enumerate(alike)]
    rows += [(2, d, x) for d, x in enumerate(alike)]
    rounds, crowds = sd.dealt_contexts(table(spark, rows), 46)
    times, sizes = met(rounds)
    sd.discard(crowds)
    assert sum(sizes) == 2 * len(alike)
    assert times == {(name, first + x, first + y): 1 for name, first in ((1, 300), (2, 0)) for y in range(8) for x in range(y)}


def test_a_round_deals_no_more_than_all_contexts_and_all_pairs_meet_once(spark, monkeypatch):
    monkeypatch.setattr(sd, "CROWD", 10)
    monkeypatch.setattr(sd, "ROUND_BYTES", 1)
    near = np.random.default_rng(2).integers(0, 1 << 32, 91, np.uint32)
    rows = [(1, d, near[d % 5:]) for d in range(95)]
    rounds, crowds = sd.dealt_contexts(table(spark, rows), 46)
    times, sizes = met(rounds)
    sd.discard(crowds)
    assert sum(sizes) == 95 * 10 and len(sizes) == 10 and max(sizes) <= 2 * 95
    assert times == {(1, x, y): 1 for y in range(95) for x in range(y)}


@pytest.mark.parametrize("seed", range(5))
def test_the_look_at_a_whole_list_leaves_what_blocks_leave(monkeypatch, seed):
    monkeypatch.setattr(sd, "LOOKED", 7)
    r = np.random.default_rng(seed)
    pool = r.integers(0, 1 << 32, 60, np.uint32)
    tokens = [np.where(r.random(n) < r.choice([0.5, 0.9]), r.choice(pool, n), r.integers(0, 1 << 32, n, np.uint32)) for n in r.integers(1, 92, 50)]
    docs = r.integers(0, 20, 50)
    begins = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
    got = sd.can_link_in_list(docs, begins, np.concatenate(tokens), 46, 40)
    want = sd.can_link(sd.coded(tokens), np.unique(docs, return_inverse=True)[1], 46, 40)
    assert set(want) <= set(got) and len(got) <= len(want) + 3 and 0 < len(want) < 50
