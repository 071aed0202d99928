"""What a worker holds: one table of projected words, and pieces of results that leave it."""

from __future__ import annotations

import numpy as np

from tidegraph.llm import toxicity


def test_projected_words_are_never_copied_to_a_larger_table():
    class Net:
        p = {"bx": np.zeros(6 * toxicity.HIDDEN, np.float32)}

        def embed(self, words):
            return (None, None, None, words)

        def project(self, words):
            return np.repeat(np.array([len(w) for w in words], np.float32)[:, None], 6 * toxicity.HIDDEN, axis=1)

    own = toxicity.Scorer(Net())
    table = own.gates
    for a in range(0, 40_000, 20_000):
        own.learn([f"w{i}" for i in range(a, a + 20_000)])
    assert own.gates is table
    assert own.gates[own.known["w123"], 0] == 4 and own.gates[own.known["w39999"], 0] == 6
