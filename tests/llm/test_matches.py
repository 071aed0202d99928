from collections import Counter
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa

from tidegraph.llm import jaccard_join


def test_matches_of_two_blocks_are_counted_without_their_pairs(monkeypatch):
    r = np.random.default_rng(5)
    for trial in range(20):
        monkeypatch.setattr(jaccard_join, "HELD", int(r.integers(1, 60)))
        light = 24
        label, size = r.integers(0, 40, 60), r.integers(10, 40, 60)
        block = r.permutation(60) % 5
        lists = {int(s): r.choice(60, int(r.integers(2, 12)), replace=False) for s in r.choice(1000, 80, replace=False)}
        # lists of pairs of elements hold light sets only
        lists = {s: [k for k in own.tolist() if not s & 1 or size[k] <= light] for s, own in lists.items()}
        rows, want = [], Counter()
        struct = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32()), ("label", pa.int64())]))
        for sig, own in lists.items():
            parts = {x: [k for k in own if block[k] == x] for x in range(5)}
            for x, y in combinations_with_replacement(range(5), 2):
                if parts[x] and parts[y]:
                    rows.append((x, y, sig, *[[{"key": k, "n": size[k], "label": label[k]} for k in parts[z]] for z in (x, y)]))
            for a, b in combinations(sorted(own), 2):
                low, high = sorted((size[a], size[b]))
                if label[a] != label[b] and 100 * low >= 75 * high and (sig & 1 or high > light):
                    want[a, b, 1 if sig & 1 else int(jaccard_join.needed(size[a], size[b]))] += 1
        needs = {}
        for (a, b, need), n in want.items():
            needs[a, b] = (needs.get((a, b), (0, 0))[0] + n, max(needs.get((a, b), (0, 0))[1], need))
        more = {(int(a), int(b)): int(r.integers(1, 4)) for a, b in combinations(range(60), 2) if r.random() < 0.2}
        met = pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), struct, struct))], ["x", "y", "sig", "xs", "ys"])
        short = pa.table([pa.array(c, pa.int64()) for c in ([a for a, _ in more], [b for _, b in more], list(more.values()))], ["a", "b", "n"])
        got = list(zip(*(x.tolist() for x in jaccard_join.enough_matches(met, short, light))))
        assert sorted(got) == sorted(p for p, (n, need) in needs.items() if n + more.get(p, 0) >= need)
        assert 0 < len(got) < len(needs)
    none = jaccard_join.enough_matches(met.slice(0, 0), short, light)
    assert [len(x) for x in none] == [0, 0]
