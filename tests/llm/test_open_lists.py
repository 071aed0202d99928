import tracemalloc

import numpy as np

from tidegraph.llm import substring_dedup as sd


def by_hand(lists, docs, others, links, centres):
    """Rows, components and whether settled, of windows in lists that are open."""
    want = []
    for name in np.unique(lists[~links]):
        own = [(i, d, c) for i, d, c in zip(np.flatnonzero((lists == name) & ~links), docs[(lists == name) & ~links], centres[(lists == name) & ~links])]
        held = {d for _, d, _ in own}
        edges = [(d, o, c) for d, o, c in zip(*(x[(lists == name) & links] for x in (docs, others, centres))) if d in held and o in held]
        label = {d: d for d in held}
        for _ in held:
            for d, o, _ in edges:
                label[d] = label[o] = min(label[d], label[o])
        done = {(d, c) for d, _, c in edges}
        if any((d, c) not in done and d != min(held) for _, d, c in own):
            want += [(i, label[d], (d, c) in done) for i, d, c in own]
    return want


def test_open_windows_equal_a_search_by_hand(monkeypatch):
    r = np.random.default_rng(2)
    for _ in range(40):
        monkeypatch.setattr(sd, "LINKS", int(r.integers(1, 50)))
        n = int(r.integers(1, 120))
        lists, docs, centres, links = r.integers(-3, 4, n), r.integers(1, 15, n), r.integers(0, 4, n), r.random(n) < 0.5
        others = np.where(links, r.integers(0, 15, n), docs)
        assert sorted(zip(*(x.tolist() for x in sd.open_windows(lists, docs, others, links, centres)))) == sorted(by_hand(lists, docs, others, links, centres))


def test_many_links_of_one_list_take_little_memory():
    r = np.random.default_rng(3)
    windows, n = 20_000, 400_000
    docs = np.concatenate((np.arange(windows) // 8, r.integers(1, windows // 8, n)))
    links = np.arange(windows + n) >= windows
    others = np.where(links, docs - 1, docs)
    centres = np.arange(windows + n) % 8
    tracemalloc.start()
    sd.open_windows(np.full(windows + n, 7), docs, others, links, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * (windows + n)
