"""Windows, bands and contexts that op2 makes without a step of Python for each."""

from __future__ import annotations

import sys

import numpy as np

from tidegraph.llm import substring_dedup as sd


def bounds_by_stack(values, begin, end):
    """Nearest smaller values on both sides, one place at a time."""
    before, after = [], []
    for i in range(len(values)):
        a, b = i - 1, i + 1
        while a >= begin[i] and values[a] > values[i]:
            a -= 1
        while b < end[i] and values[b] > values[i]:
            b += 1
        before.append(a)
        after.append(b)
    return before, after


def test_nearest_smaller_values_stay_inside_their_text():
    r = np.random.default_rng(4)
    for _ in range(60):
        lengths = r.integers(1, 30, r.integers(1, 8))
        ends = np.cumsum(lengths)
        values = r.permutation(int(ends[-1])).astype(np.uint64)
        begin, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
        before, after = bounds_by_stack(values.tolist(), begin, end)
        assert sd._smaller(values, begin - 1, -1).tolist() == before
        assert sd._smaller(values, end, 1).tolist() == after


def steps_of(call) -> int:
    """Lines of this package that run in a call."""
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        if "tidegraph" not in frame.f_code.co_filename:
            return None
        lines += event == "line"
        return trace

    sys.settrace(trace)
    try:
        call()
    finally:
        sys.settrace(None)
    return lines


def test_windows_take_no_step_for_each():
    s = np.random.default_rng(5).integers(0, 1 << 60, 40_000).astype(np.uint64)
    made = []
    assert steps_of(lambda: made.append(sd.compact_windows(s, np.array([0, 15_000, 40_000]), 46, 0))) < 500
    assert len(made[0][0]) > 1_000


def test_bands_inside_others_are_left_out_and_no_stretch_with_them():
    r = np.random.default_rng(6)
    x, y = r.integers(0, 1 << 30, 400).astype(np.uint32), r.integers(0, 1 << 30, 400).astype(np.uint32)
    y[100:180] = x[20:100]
    assert sd.matching_stretches(x, y, 46) == [(20, 99)]
    assert sd._not_inside(np.array([False, True, False, False]), np.arange(4)).tolist() == [False, False, True, False]
    # bands 1 and 2 hold matches: band 2 has those of both, bands 1 and 3 no others
    assert sd._not_inside(np.array([False, True, True, False, False]), np.arange(5)).tolist() == [False, False, True, False, False]
