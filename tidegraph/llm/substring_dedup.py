"""Repeated and nearly repeated passages by compact windows of min-hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard_join import _dealt
from .support import byte_groups, discard, give_back, map_batches, materialize, partitions_for, total_bytes
from .words import SHINGLE, Words, mix

#: Passages have this many words at least.
LEAST_WORDS = 50
#: Hash functions, and how many must agree on a place.
HASHES, AGREE = 5, 2
PERCENT = 75
GRID = 64
BUCKET_BYTES = 10 << 20
#: Lists of up to this many windows give all their pairs.
SHORT_LIST = 8
#: Contexts of an open list in a block, and tokens counted at once there.
CROWD, COUNTED = 1024, 4096
#: Contexts of a whole list that are looked at at once.
LOOKED = 1 << 14
#: Slots up to which each token has eight, not two.
SLOTS = 1 << 24
#: Bytes of contexts that a round may deal out, at least.
ROUND_BYTES = 64 << 20
#: Contexts that are tested against one at once.
BANDED = 64
#: Pairs of equal tokens of two slices that are held at once.
MATCHED = 1 << 20
#: Contexts that leave a worker at once.
CONTEXTS = 1 << 16
#: Meetings of windows that leave a worker at once.
MEETINGS = 1 << 16
#: Links of windows that are looked up at once.
LINKS = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0xA0761D6478BD642F)


def sliding_minima(g: np.ndarray, t: int) -> np.ndarray:
    """Least value of each ``t`` neighbours, from running minima of blocks in both directions."""
    n = len(g)
    blocks = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = g
    blocks = blocks.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - t + 1], ahead[t - 1:n])


def compact_windows(s: np.ndarray, offsets: np.ndarray, t: int, which: int) -> tuple[np.ndarray, ...]:
    """All compact windows of width ``t`` or more under one hash function: centre, first, last place.

    ``s`` holds the texts' tokens one after another, ``offsets`` where each begins and the end. The least
    hash of every subsequence of t tokens or more that lies in [first, last] and holds the centre is the
    centre's. Centres are the minima of windows of t; their bounds are the nearest centres with smaller
    hashes, since any token outside that has a smaller hash than a centre is itself a centre.
    """
    n = len(s)
    none = np.zeros(0, np.int64)
    if n < t:
        return none, none, none
    g = (mix(s + _STEP * np.array([which + 1], np.uint64)) & ~_PLACE) | np.arange(n, dtype=np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values = sliding_minima(g, t)[doc[:n - t + 1] == doc[t - 1:]]
    if not len(values):
        return none, none, none
    values = values[np.concatenate(([True], values[1:] != values[:-1]))]
    centres = (values & _PLACE).astype(np.int64)
    owners = doc[centres]
    number = np.arange(len(values))
    new = np.concatenate(([True], owners[1:] != owners[:-1]))
    begin = number[new][np.cumsum(new) - 1]
    end = np.append(number[new][1:], len(values))[np.cumsum(new) - 1]
    before, after = _smaller(values, begin - 1, -1), _smaller(values, end, 1)
    first = np.where(before < begin, offsets[owners], centres[before] + 1)
    last = np.where(after == end, offsets[owners + 1], centres[np.minimum(after, len(values) - 1)]) - 1
    return centres, first, last


def _smaller(values: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest place in the direction of ``step`` with a smaller value, or its ``bound``.

    All between a place and its candidate is larger, so where the candidate is larger too, what the candidate
    has as its own comes next.
    """
    out = np.arange(len(values)) + step
    left = np.flatnonzero(out != bound)
    left = left[values[out[left]] > values[left]]
    while len(left):
        out[left] = out[out[left]]
        left = left[out[left] != bound[left]]
        left = left[values[out[left]] > values[left]]
    return out


def overlaps(f: np.ndarray, first: np.ndarray, last: np.ndarray, agree: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of ``least`` places or more on which windows of ``agree`` hash functions lie."""
    events = []
    for h in np.unique(f):
        own = np.flatnonzero(f == h)
        own = own[np.argsort(first[own], kind="stable")]
        a, b = None, None
        for x, y in zip(first[own].tolist(), last[own].tolist()):
            if a is None or x > b + 1:
                if a is not None:
                    events += [(a, 1), (b + 1, -1)]
                a, b = x, y
            else:
                b = max(b, y)
        events += [(a, 1), (b + 1, -1)]
    out, count, begun = [], 0, None
    for place, step in sorted(events):
        count += step
        if begun is None and count >= agree:
            begun = place
        elif begun is not None and count < agree:
            if place - begun >= least:
                out.append((begun, place - 1))
            begun = None
    return out


def first_copies(s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the first place with the same ``width`` tokens from there on (the end counts as
    different from all), and which tokens lie in the first copy of some such run."""
    n = len(s)
    h = mix(np.concatenate((s.astype(np.uint64), np.arange(width, dtype=np.uint64) + np.uint64(1 << 32))))
    step = 1
    while 2 * step <= width:
        h = mix(h[:-step] * _STEP + h[step:])
        step *= 2
    if step < width:
        h = mix(h[:step - width] * _STEP + h[width - step:])
    _, at, back = np.unique(h[:n], return_index=True, return_inverse=True)
    edge = np.zeros(n + width + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return at[back], np.cumsum(edge)[:n] > 0


def _not_inside(held: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Which of the bands have matches that the next or the former band doesn't have all. Matches with ``held`` number
    b lie in the bands b and b + 1; more matches never take a stretch away."""
    former, second = ((bands >= n) & held[..., np.maximum(bands - n, 0)] for n in (1, 2))
    return former & (held[..., bands] | ~second)


def matching_stretches(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of ``x`` in which windows of ``least`` tokens stand in ``y`` along a diagonal.

    A window and as many tokens of ``y`` that share c of them have Jaccard c / (2 * least - c); the
    windows with PERCENT or more are joined where they meet or overlap. All places of a token in ``y`` count:
    matches are taken by bands of diagonals, wide enough for the insertions that a window can hold, and those
    of a window and band must reach the share in ``x`` and in ``y``. Of equal runs of tokens only the first
    is compared, so that repeated lines don't multiply.
    """
    need = -(-2 * PERCENT * least // (100 + PERCENT))
    if len(x) < least or len(y) < need:
        return []
    reach = GRID // 4 * max(1, (least - need) // (SHINGLE - 1))
    order = np.argsort(y)
    ys = y[order]
    lo, hi = np.searchsorted(ys, x), np.searchsorted(ys, x, side="right")
    if np.count_nonzero(hi > lo) < need:
        return []
    same = None
    if (hi - lo).sum() > 4 * (len(x) + len(y)):
        same, use = first_copies(x, least)
        order = order[first_copies(y, least + 2 * reach)[1][order]]
        ys = y[order]
        lo, hi = np.searchsorted(ys, x), np.searchsorted(ys, x, side="right")
        lo[~use] = hi[~use]
    good = np.zeros(len(x) - least + 1, bool)
    total = np.concatenate(([0], np.cumsum(hi - lo)))
    a = 0
    while a < len(good):
        # windows that begin in [a, b), with at most about MATCHED pairs
        b = max(a + 1, min(len(good), int(np.searchsorted(total, total[a] + MATCHED, side="right")) - least))
        part = slice(max(0, a - least), min(len(x), b + 2 * least - 1))
        n = (hi - lo)[part]
        i = np.repeat(np.arange(part.start, part.stop), n)
        j = order[np.repeat(lo[part], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        band = (i - j + len(y)) // reach
        held = np.bincount(band, minlength=(len(x) + len(y)) // reach + 2) > 0
        band = np.concatenate((band, band + 1))
        if len(held) < 1 << 16:
            band = band.astype(np.uint16)  # sorted by its digits
        band_order = np.argsort(band, kind="stable")
        band = band[band_order]
        band_order[band_order >= len(i)] -= len(i)
        cuts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
        many = np.flatnonzero(np.diff(cuts) >= need)
        for g in many[_not_inside(held, band[cuts[many]].astype(np.int64))] if len(many) else many:
            own = band_order[cuts[g]:cuts[g + 1]]
            p, q = i[own], j[own]
            at = np.flatnonzero(np.bincount(p))
            if len(at) < need or (at[need - 1:] - at[:len(at) - need + 1]).min() >= least:
                continue
            first, size = int(at[0]) - least + 1, int(at[-1] - at[0]) + 2 * least
            in_x = np.bincount(at - first - least + 1, minlength=size) - np.bincount(at - first + 1, minlength=size)
            # a token of y counts once a window: from after its last use, or where the window first holds it
            q, p = np.divmod(np.sort(q * len(x) + p), len(x))
            begin = p - first - least + 1
            again = np.flatnonzero(q[1:] == q[:-1]) + 1
            begin[again] = np.maximum(begin[again], p[again - 1] - first + 1)
            in_y = np.bincount(begin, minlength=size) - np.bincount(p - first + 1, minlength=size)
            hit = np.flatnonzero((np.cumsum(in_x) >= need) & (np.cumsum(in_y) >= need)) + first
            # a window lies between the first and the last match of a run
            ends = at[np.concatenate((np.flatnonzero(np.diff(at) > least), [len(at) - 1]))]
            before = np.searchsorted(at, hit, side="right") - 1
            last = ends[np.searchsorted(ends, at[np.maximum(before, 0)])]
            good[hit[(before >= 0) & (hit + least - 1 <= last) & (hit >= a) & (hit < b)]] = True
        a = b
    if same is not None:
        good = good[same[:len(good)]]
    good = np.flatnonzero(good)
    if not len(good):
        return []
    return [(int(k[0]), int(k[-1]) + least - 1) for k in np.split(good, np.flatnonzero(np.diff(good) > least) + 1)]


def open_windows(lists: np.ndarray, docs: np.ndarray, others: np.ndarray, links: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of the lists that verified links leave open: their rows, components and whether each is settled.

    Rows with ``links`` are verified links (list, doc, smaller doc, centre of the doc's window), the rest are
    windows. A window is settled when a link of its own leads to a smaller document of the list; a component is
    named by its smallest document. A list is open while windows other than its smallest document's are not
    settled.
    """
    own, by = np.flatnonzero(~links), np.flatnonzero(links)
    if not len(own):
        return own, docs[own], links[own]
    order = np.lexsort((docs[own], lists[own]))
    new = np.concatenate(([True], (np.diff(lists[own][order]) != 0) | (np.diff(docs[own][order]) != 0)))
    node = np.empty(len(own), np.int64)
    node[order] = np.cumsum(new) - 1
    name, home = docs[own][order][new], lists[own][order][new]
    (list_names, in_list), (doc_names, in_doc) = (np.unique(x, return_inverse=True) for x in (home, name))
    nodes = in_list * len(doc_names) + in_doc
    low, wide = int(centres.min()), int(centres.max()) - int(centres.min()) + 1
    windows, window = np.unique(node * wide + (centres[own] - low), return_inverse=True)
    linked = np.zeros(len(windows), bool)

    def places(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return at, names[at] == x

    # links between documents that the list holds, a part at a time: there may be many for each window
    edges = np.zeros(0, np.int64)
    for k in range(0, len(by), LINKS):
        part = by[k:k + LINKS]
        at, _ = places(list_names, lists[part])
        ends, held = [], lists[part] == list_names[at]
        for ids in (docs, others):
            doc, there = places(doc_names, ids[part])
            end, met = places(nodes, at * len(doc_names) + doc)
            ends.append(end)
            held &= there & met
        x, y = (e[held] for e in ends)
        edges = np.union1d(edges, x * len(name) + y)
        # a link is of the window whose centre it holds
        where, met = places(windows, x * wide + (centres[part][held] - low))
        linked[where[met]] = True
    a, b = edges // len(name), edges % len(name)
    label = np.arange(len(name))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    settled, mine = linked[window], node
    first = np.concatenate(([True], home[1:] != home[:-1]))
    left = np.unique(lists[own][~settled & ~first[mine]])
    use = np.isin(lists[own], left)
    return own[use], name[label[mine[use]]], settled[use]


def coded(tokens: list[np.ndarray]) -> np.ndarray:
    """Token rows as small numbers, filled up with -1."""
    sizes = np.array([len(x) for x in tokens])
    out = np.full((len(tokens), int(sizes.max())), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.unique(np.concatenate(tokens), return_inverse=True)[1]
    return out


def shared_places(codes: np.ndarray) -> np.ndarray:
    """For each two rows x, y of ``coded`` how many places of x hold a token of y."""
    row, at = np.nonzero(codes >= 0)
    code = codes[row, at]
    width = int(code.max()) + 1
    cell, times = np.unique(row * width + code, return_counts=True)
    row, code = cell // width, cell % width
    common = np.bincount(code, minlength=width) >= 2
    number = np.cumsum(common) - 1
    row, code, times = row[common[code]], number[code[common[code]]], times[common[code]]
    out = np.zeros((len(codes), len(codes)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code, times = row[order], code[order], times[order]
    for a in range(0, int(common.sum()), COUNTED):
        part = slice(*np.searchsorted(code, [a, a + COUNTED]))
        places = np.zeros((len(codes), min(COUNTED, int(common.sum()) - a)), np.float32)
        places[row[part], code[part] - a] = times[part]
        out += places @ (places > 0).astype(np.float32).T
    return out


def reach_of(least: int, need: int) -> int:
    """Places of y over which the matches of a window of x may lie in ``matching_stretches``."""
    return least + 2 * (GRID // 4 * max(1, (least - need) // (SHINGLE - 1)))


def can_link(codes: np.ndarray, docs: np.ndarray, least: int, need: int) -> np.ndarray:
    """Rows with a window of ``least`` places of which ``need`` hold a token that stands in other documents' rows too;
    rows that have none are taken away until all have one."""
    rows = np.arange(len(codes))
    while len(rows):
        own = codes[rows]
        row, at = np.nonzero(own >= 0)
        code, doc = own[row, at], docs[rows][row]
        low, high = np.full(int(code.max()) + 2, np.iinfo(np.int64).max), np.full(int(code.max()) + 2, -1)
        np.minimum.at(low, code, doc)
        np.maximum.at(high, code, doc)
        total = np.concatenate((np.zeros((len(own), 1), np.int64), np.cumsum((low < high)[own], axis=1)), axis=1)
        wide = min(reach_of(least, need), codes.shape[1])
        good = (total[:, wide:] - total[:, :-wide]).max(axis=1, initial=0) >= need
        if good.all():
            break
        rows = rows[good]
    return rows


def can_link_in_list(docs: np.ndarray, begins: np.ndarray, tokens: np.ndarray, least: int, need: int) -> np.ndarray:
    """What ``can_link`` leaves of a whole list, or more: rows of ``docs`` with tokens from ``begins`` on.

    Tokens are told apart by their last bits only, so that memory goes with the tokens; two that look the same
    can keep a row, never take one away.
    """
    number = np.unique(docs, return_inverse=True)[1].astype(np.int32)
    n, wide = np.diff(begins), reach_of(least, need)
    rows = np.flatnonzero(n >= need)
    while len(rows):
        held_tokens = int(n[rows].sum())
        slots = 1 << (max(2 * held_tokens, min(8 * held_tokens, SLOTS)) - 1).bit_length()
        first, several = np.full(slots, -1, np.int32), np.zeros(slots, bool)
        good = np.zeros(len(rows), bool)
        for last in (False, True):
            for a in range(0, len(rows), LOOKED):
                own = rows[a:a + LOOKED]
                ends = np.cumsum(n[own])
                slot = tokens[np.repeat(begins[own] - (ends - n[own]), n[own]) + np.arange(int(ends[-1]))] & np.uint32(slots - 1)
                if last:
                    total = np.concatenate(([0], np.cumsum(several[slot])))
                    at = np.arange(int(ends[-1]))
                    held = total[np.minimum(at + wide, np.repeat(ends, n[own]))] - total[at]
                    good[a:a + LOOKED] = np.maximum.reduceat(held, ends - n[own]) >= need
                else:
                    doc = np.repeat(number[own], n[own])
                    new = first[slot] < 0
                    first[slot[new]] = doc[new]
                    several[slot[first[slot] != doc]] = True
        if good.all():
            break
        rows = rows[good]
    return rows


def share_a_window(x: np.ndarray, ys: np.ndarray, least: int, need: int) -> np.ndarray:
    """Which rows of ``ys`` have a window of ``least`` places with ``need`` tokens of x, and x one with theirs."""
    _, number = np.unique(x, return_inverse=True)
    to = np.full(int(max(x.max(), ys.max())) + 2, number.max() + 1)
    to[x] = number
    to[-1] = number.max() + 1
    meet = to[ys]
    in_y = meet <= number.max()
    held = np.zeros((len(ys), int(number.max()) + 2), bool)
    held[np.arange(len(ys))[:, None], meet] = True
    out = np.ones(len(ys), bool)
    for hit, wide in ((in_y, min(reach_of(least, need), ys.shape[1])), (held[:, number], least)):
        total = np.concatenate((np.zeros((len(ys), 1), np.int64), np.cumsum(hit, axis=1)), axis=1)
        out &= (total[:, wide:] - total[:, :-wide]).max(axis=1, initial=0) >= need
    return out


def share_a_band(x: np.ndarray, ys: np.ndarray, least: int, need: int) -> np.ndarray:
    """Which rows of ``ys`` (of ``coded``) can give a stretch in ``matching_stretches``: in one of its bands of diagonals
    a window of ``least`` places of x, between the first and the last match, has ``need`` matches, and ``need`` places
    of y have one. x is without filling."""
    if len(x) < least:
        return np.zeros(len(ys), bool)
    reach = (reach_of(least, need) - least) // 2
    order = np.argsort(x, kind="stable")
    lo, hi = np.searchsorted(x[order], ys), np.searchsorted(x[order], ys, side="right")
    hi[ys < 0] = lo[ys < 0]
    sizes = (ys >= 0).sum(axis=1)
    wide, out = ys.shape[1], np.zeros(len(ys), bool)
    bands = (len(x) + wide) // reach + 2
    for a in range(0, len(ys), BANDED):
        row, j = np.nonzero((hi > lo)[a:a + BANDED])
        n = (hi - lo)[a + row, j]
        first = np.cumsum(n) - n
        i = order[np.repeat(lo[a + row, j], n) + np.arange(int(n.sum())) - np.repeat(first, n)]
        row, j = np.repeat(row, n), np.repeat(j, n)
        band = (i - j + sizes[a + row]) // reach
        one = np.zeros((min(BANDED, len(ys) - a), bands), bool)
        one[row, band] = True
        in_x, in_y = (np.zeros((min(BANDED, len(ys) - a), bands, k), bool) for k in (len(x), wide))
        for b in (band, band + 1):
            in_x[row, b, i] = True
            in_y[row, b, j] = True
        enough = (in_y.sum(axis=2) >= need) & _not_inside(one, np.arange(bands))
        at = np.nonzero(enough & (in_x.sum(axis=2) >= need))
        held = in_x[at]
        total = np.concatenate((np.zeros((len(held), 1), np.int64), np.cumsum(held, axis=1)), axis=1)
        begin = np.arange(len(x) - least + 1)
        begun, ended = held.argmax(axis=1)[:, None], len(x) - held[:, ::-1].argmax(axis=1)[:, None]
        good = (total[:, least:] - total[:, :-least] >= need) & (begin >= begun) & (begin + least <= ended)
        out[a + at[0][good.any(axis=1)]] = True
    return out


def context_links(ids: np.ndarray, comps: np.ndarray, settled: np.ndarray, sides: np.ndarray, tokens: list[np.ndarray], least: int) -> list[tuple[int, int, int, int]]:
    """Verified links between the contexts of one list: rows x, y and the stretch of x, x of the larger document.

    Contexts on different sides are compared, or all where there is one side. Each with all of smaller documents
    as long as it is not settled, after that with those of other components; links found here count too.
    """
    need = -(-2 * PERCENT * least // (100 + PERCENT))
    codes, number = coded(tokens), np.unique(ids, return_inverse=True)[1]
    left = can_link(codes, number, least, need)
    if len(left) < len(ids):
        rows = context_links(ids[left], comps[left], settled[left], sides[left], [tokens[x] for x in left], least) if len(left) > 1 else []
        return [(int(left[x]), int(left[y]), a, b) for x, y, a, b in rows]
    places = shared_places(codes)
    near = (places >= need) & (places.T >= need) & (ids[:, None] > ids[None, :])
    if sides.min() != sides.max():
        near &= sides[:, None] != sides[None, :]
    comps, out = comps.copy(), []
    for x in np.argsort(ids, kind="stable").tolist():
        done = bool(settled[x])
        ys = np.flatnonzero(near[x] & (comps != comps[x]) if done else near[x])
        if len(ys):
            ys = ys[share_a_window(codes[x][:len(tokens[x])], codes[ys], least, need)]
        if len(ys):
            ys = ys[share_a_band(codes[x][:len(tokens[x])], codes[ys], least, need)]
        for y in ys[np.argsort(ids[ys], kind="stable")].tolist():
            if done and comps[x] == comps[y]:
                continue
            stretches = matching_stretches(tokens[x], tokens[y], least)
            if stretches:
                out += [(x, y, a, b) for a, b in stretches]
                done = True
                comps[comps == max(comps[x], comps[y])] = min(comps[x], comps[y])
    return out


def dealt_contexts(classes: DataFrame, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Contexts of lists dealt to the pairs of their blocks, in rounds, and the table that these read beside ``classes``.

    Lists of up to CROWD contexts are one block. Longer ones are first looked at whole, and only contexts that can
    link in them go on. In a list of n blocks each row stands for n pairs; these are spread over as many rounds as
    keep the copies of one round below the bytes of all contexts.
    """
    need = -(-2 * PERCENT * least // (100 + PERCENT))
    columns = ["list", "h", "doc", "lo", "comp", "settled", "tokens"]
    weigh = lambda table: table.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("tokens")).alias("bytes"))
    sizes = weigh(classes)

    def linkable(table: pa.Table) -> pa.Table:
        give_back()
        blobs = table.column("tokens").combine_chunks()
        begins = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(blobs) + 1].astype(np.int64) // 4
        rows = can_link_in_list(table.column("doc").to_numpy(), begins, np.frombuffer(blobs.buffers()[2], np.uint32, int(begins[-1])), least, need)
        return table.select(columns).take(pa.array(rows))

    long_lists = sizes.where(F.col("n") > CROWD).select("list")
    crowds = materialize(classes.select(columns).join(long_lists, "list").groupBy("list").applyInArrow(linkable, "list long, h long, doc long, lo long, comp long, settled boolean, tokens binary"), "passage-crowds")
    blocks = weigh(crowds).select("list", "bytes", F.ceil(F.col("n") / CROWD).alias("blocks"))
    copies = int(blocks.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0)
    rounds = partitions_for(copies, max(ROUND_BYTES, total_bytes(classes, "tokens")))
    short = classes.select(columns).join(sizes.where(F.col("n").between(2, CROWD)).select("list"), "list").withColumn("blocks", F.lit(1).cast("long"))
    out = []
    for r in range(rounds):
        rows = crowds.join(blocks.drop("bytes"), "list").select(*columns, "blocks")
        rows = (rows.union(short) if r == 0 else rows).withColumn("block", F.pmod(F.col("h"), F.col("blocks")))
        ks = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: (F.col("block") + k) % rounds == r)
        out.append(rows.withColumn("k", F.explode(ks)).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).select("list", "i", "j", "block", "doc", "lo", "comp", "settled", "tokens"))
    return out, crowds


def merged(found: DataFrame) -> DataFrame:
    """Passages of a document and source joined where they overlap."""
    pair = Window.partitionBy("doc_id", "source_id").orderBy("begin_word", "end_word")
    reach = F.max("end_word").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.withColumn("begun", F.when(F.col("begin_word") < reach, 0).otherwise(1))
    numbered = begun.withColumn("passage", F.sum("begun").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "source_id", "passage").agg(F.min("begin_word").alias("begin_word"), F.max("end_word").alias("end_word")).drop("passage")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that nearly repeat a passage of a document with a smaller id.

    Tokens are five-word shingles. For each of five hash functions the compact windows of a text group all
    its subsequences by min-hash; windows of different documents with the same min-hash meet: all pairs of
    lists of up to SHORT_LIST windows, in longer ones first each with the first document and with the one before
    it. For a pair of documents, stretches under windows of two hash functions or more are candidates; the
    shingles there (32 bits of their hashes) are compared in windows of 50 words with Jaccard 0.75 or more.
    Longer lists in which this left a window without a link to a smaller document are open: there the contexts
    of the windows (the places that a passage of the least width around the centre can reach, equal contexts
    once) are compared in blocks, each with those of all smaller documents until it has a link, and with those
    of other components of the list whether it has one or not. So links left out lie inside a component of a
    list, of windows that have a link to a smaller document already.
    Copies of a whole text are found by its hash and give one passage with all their words, repeated from the
    smallest id among them; only that document's windows stand for the text, whatever the order of the rows.

    Nulls: null and short texts have no passages, rows without an id are left out. Rows with the same id are
    one document. An empty table gives an empty result; other columns are ignored.
    Returns doc_id, source_id (the other document), begin_word, end_word (exclusive); passages of a pair don't overlap.
    """
    docs = docs.selectExpr(f"cast({doc_id} as long) as doc_id", f"{text} as text").where("doc_id is not null")
    t = least_words - SHINGLE + 1
    buckets = partitions_for(total_bytes(docs, "text"), BUCKET_BYTES, 8)

    # each text once, under its smallest id
    keyed = docs.where("text is not null").withColumns({"h": F.xxhash64("text"), "g": F.hash("text")})
    unique = keyed.groupBy("h", "g").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        told: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, told
            rows = []
            if held:
                sig, ids, *places = (np.concatenate([x[i] for x in held]) for i in range(5))
                rows = [(i, *x) for i, x in _dealt(buckets, sig, sig, ids, *(x.astype(np.int32) for x in places))]
            if told:
                ids, keys, n = (np.array([x[i] for x in told], np.int64) for i in range(3))
                rows += [(-1 - i, *x) for i, x in _dealt(buckets, keys.view(np.uint64), keys, ids, *[n.astype(np.int32)] * 3)]
            held, told = [], []
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 6)]], ["bucket", "sigs", "ids", "firsts", "lasts", "centres"])

        size = 0
        for batch in batches:
            for a, b in byte_groups(batch, "text", 2 << 20):
                ids, keys, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "h", "text"))
                words = Words(texts)
                seqs = words.sequences()
                counts = np.diff(words.offsets).tolist()
                use = [i for i in range(len(texts)) if counts[i] >= least_words]
                told += [(ids[i], keys[i], counts[i]) for i in use]
                if not use:
                    continue
                s = np.concatenate([seqs[i] for i in use])
                offsets = np.concatenate(([0], np.cumsum([len(seqs[i]) for i in use])))
                own = np.array([ids[i] for i in use], np.int64)
                for h in range(HASHES):
                    c, first, last = compact_windows(s, offsets, t, h)
                    at = np.searchsorted(offsets, c, side="right") - 1
                    sig = (mix(s[c] ^ (_STEP * np.array([h + 1], np.uint64))) & ~np.uint64(7)) | np.uint64(h)
                    held.append((sig, own[at], first - offsets[at], last - offsets[at], c - offsets[at]))
                    size += len(c)
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if held or told:
            yield flush()

    whole = lambda table, c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
    names = ["kind", "doc", "other", "f", "first", "last", "ofirst", "olast"]

    def meet(table: pa.Table) -> pa.Table:
        give_back()
        sig, ids = whole(table, "sigs", np.uint64), whole(table, "ids", np.int64)
        first, last = whole(table, "firsts", np.int32), whole(table, "lasts", np.int32)
        if table.column("bucket")[0].as_py() < 0:
            # lengths of whole texts, by text key
            return meetings(0, ids, ids, sig.view(np.int64), first, last, first, last)
        centre = whole(table, "centres", np.int32)
        order = np.lexsort((first, ids, sig))
        sig, ids, first, last, centre = (x[order] for x in (sig, ids, first, last, centre))
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        heads = np.flatnonzero(new)
        length = np.diff(np.append(heads, len(sig)))
        ends = heads + length - 1
        i = np.flatnonzero(np.repeat((length > SHORT_LIST) & (ids[heads] != ids[ends]), length))
        x1 = i[ids[i] != ids[begin[i]]]
        x2 = i[i > begin[i]]
        x2 = x2[(ids[x2] != ids[x2 - 1]) & (x2 - 1 != begin[x2]) & (ids[x2 - 1] != ids[begin[x2]])]
        xs, ys = [x1, x2], [begin[x1], x2 - 1]
        for n in range(2, SHORT_LIST + 1):
            at = heads[length == n]
            for p, q in combinations(range(n), 2) if len(at) else ():
                own = at[ids[at + p] != ids[at + q]]
                xs.append(own + q)
                ys.append(own + p)
        x, y = np.concatenate(xs), np.concatenate(ys)
        f = (sig[x] & np.uint64(7)).astype(np.int64)
        met = meetings(1, ids[x], ids[y], f, first[x], last[x], first[y], last[y])
        # windows of longer lists: the list, and what a passage of the least width around the centre can reach
        c = centre[i]
        lo, hi = np.maximum(first[i], c - t + 1), np.minimum(last[i], c + t - 1)
        return pa.concat_tables([met, meetings(2, ids[i], sig[i].view(np.int64), c.astype(np.int64), lo, hi, lo, hi)])

    kinds = dict(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4)))

    def meetings(kind: int, *columns: np.ndarray) -> pa.Table:
        rows = pa.table([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], pa.schema(list(kinds.items())))
        return pa.Table.from_batches(rows.to_batches(max_chunksize=MEETINGS), rows.schema)

    schema = ", ".join(f"{c} {'int' if k == pa.int32() else 'long'}" for c, k in kinds.items())
    blobs = map_batches(unique, windows, "bucket int, sigs binary, ids binary, firsts binary, lasts binary, centres binary")
    met = materialize(blobs.groupBy("bucket").applyInArrow(meet, schema), "passage-meetings")

    def join_intervals(table: pa.Table) -> pa.Table:
        doc, other, f, first, last, ofirst, olast = (table.column(c).to_numpy() for c in names[1:])
        order = np.lexsort((first, f, other, doc))
        doc, other, f, first, last, ofirst, olast = (x[order] for x in (doc, other, f, first, last, ofirst, olast))
        cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]), [True])))
        distinct = np.concatenate(([1], ((f[1:] != f[:-1]) | (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])).astype(int)))
        kinds = np.add.reduceat(distinct, cuts[:-1])
        rows = []
        for g in np.flatnonzero(kinds >= AGREE):
            own = slice(cuts[g], cuts[g + 1])
            for a, b in overlaps(f[own], first[own], last[own], AGREE, t):
                near = (first[own] <= b) & (last[own] >= a)
                rows.append((doc[own][0], other[own][0], a // GRID * GRID, -(-(b + 1) // GRID) * GRID, ofirst[own][near].min() // GRID * GRID, -(-(olast[own][near].max() + 1) // GRID) * GRID))
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(list(c), pa.int64()) for c in cols], ["doc", "other", "a", "b", "c", "d"])

    meetings = met.where("kind = 1")
    candidates = materialize(meetings.groupBy(F.pmod(F.xxhash64("doc"), F.lit(buckets * 4)).alias("part")).applyInArrow(lambda table: join_intervals(table.drop_columns([x for x in table.column_names if x not in names])), "doc long, other long, a long, b long, c long, d long").distinct(), "passage-candidates")
    wanted = candidates.select("doc", "a", "b").union(candidates.select("other", "c", "d")).toDF("doc", "a", "b").distinct()
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = docs.join(wanted, docs["doc_id"] == wanted["doc"]).groupBy("doc").agg(F.min("text").alias("text"), F.first("spans").alias("spans"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in byte_groups(batch, "text", 2 << 20):
                part = batch.slice(i, j - i)
                rows = [(d, x["a"], x["b"], (s[x["a"]:x["b"]] >> np.uint64(32)).astype(np.uint32).tobytes()) for d, s, spans in zip(part.column("doc").to_pylist(), Words(part.column("text").to_pylist()).sequences(), part.column("spans").to_pylist()) for x in spans]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "a", "b", "tokens"])

    cut = materialize(map_batches(texts, slices, "doc long, a long, b long, tokens binary"), "passage-slices")
    both = candidates.join(cut.toDF("doc", "a", "b", "x"), ["doc", "a", "b"]).join(cut.toDF("other", "c", "d", "y"), ["other", "c", "d"]).select("doc", "other", "a", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, o, a, x, y in zip(*(batch.column(c) for c in ("doc", "other", "a", "x", "y"))):
                a = a.as_py()
                rows += [(d.as_py(), o.as_py(), a + i, a + j + SHINGLE) for i, j in matching_stretches(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), t)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "source_id", "begin_word", "end_word"])

    found = materialize(map_batches(both, check, "doc_id long, source_id long, begin_word long, end_word long"), "passage-found")
    discard(candidates, cut)
    more = _open_links(docs, met.where("kind = 2").select(F.col("other").alias("list"), "doc", F.col("f").alias("centre"), F.col("first").alias("lo"), F.col("last").alias("hi")), found, t, buckets)
    lengths = met.where("kind = 0").select(F.col("f").alias("h"), F.col("doc").alias("source_id"), F.col("last").alias("end_word"))
    several = keyed.groupBy("h", "g").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("top")).where("top > source_id").join(lengths, ["h", "source_id"])
    copies = keyed.select("doc_id", "h", "g").join(several, ["h", "g"]).where("doc_id > source_id").select("doc_id", "source_id", F.lit(0).cast("long").alias("begin_word"), "end_word")
    return merged(found.union(more)).union(copies).distinct()


def _open_links(docs: DataFrame, windows: DataFrame, found: DataFrame, t: int, buckets: int) -> DataFrame:
    """Links inside open lists: windows are (list, doc, centre, lo, hi), found the links verified so far."""
    holds = (F.col("begin_word") <= F.col("centre")) & (F.col("centre") + SHINGLE <= F.col("end_word"))
    links = windows.join(found, (windows["doc"] == found["doc_id"]) & holds).select("list", "doc", "centre", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.col("source_id").alias("other"), F.lit(True).alias("link")).distinct()
    rows = windows.select("*", F.col("doc").alias("other"), F.lit(False).alias("link")).union(links)

    def still_open(table: pa.Table) -> pa.Table:
        lists, doc, centre, lo, hi, other = (table.column(c).to_numpy() for c in ("list", "doc", "centre", "lo", "hi", "other"))
        at, comp, settled = open_windows(lists, doc, other, table.column("link").to_numpy().astype(bool), centre)
        return pa.table([*(pa.array(x[at]) for x in (lists, doc, lo, hi)), pa.array(comp), pa.array(settled)], ["list", "doc", "lo", "hi", "comp", "settled"])

    part = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).alias("part")
    left = materialize(rows.groupBy(part(buckets * 2, "list")).applyInArrow(lambda table: still_open(table), "list long, doc long, lo long, hi long, comp long, settled boolean"), "passage-open")
    spans = left.groupBy("doc").agg(F.collect_list(F.struct("list", "lo", "hi", "comp", "settled")).alias("spans"))
    texts = docs.join(spans, docs["doc_id"] == spans["doc"]).groupBy("doc").agg(F.min("text").alias("text"), F.first("spans").alias("spans"))
    names, names_of_spans = ["list", "doc", "lo", "comp", "settled", "tokens"], ["list", "lo", "hi", "comp", "settled"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in byte_groups(batch, "text", 2 << 20):
                own = batch.slice(i, j - i)
                seqs = Words(own.column("text").to_pylist()).sequences()
                begins = np.concatenate(([0], np.cumsum([len(x) for x in seqs])))
                short = (np.concatenate(seqs) >> np.uint64(32)).astype(np.uint32)
                spans = own.column("spans")
                lists, lo, hi, comp, settled = (spans.flatten().field(x).to_numpy(zero_copy_only=False) for x in names_of_spans)
                owner = np.repeat(np.arange(len(seqs)), spans.value_lengths().to_numpy())
                # of equal contexts of a document in a list, one that is not settled stands for all
                order = np.lexsort((lo, settled, lists, owner))
                new = np.concatenate(([True], (np.diff(lists[order]) != 0) | (np.diff(owner[order]) != 0), [True]))
                begin, keep, n = lo + begins[owner], np.ones(len(order), bool), hi - lo + 1
                for a in np.flatnonzero(new[:-1] & ~new[1:]).tolist():
                    seen = set()
                    while True:
                        x = order[a]
                        token = short[begin[x]:begin[x] + n[x]].tobytes()
                        keep[a] = token not in seen
                        seen.add(token)
                        a += 1
                        if new[a]:
                            break
                order = order[keep]
                docs_of = own.column("doc").to_numpy()[owner]
                for a in range(0, len(order), CONTEXTS):
                    x = order[a:a + CONTEXTS]
                    ends = np.cumsum(n[x])
                    tokens = short[np.repeat(begin[x] - (ends - n[x]), n[x]) + np.arange(int(ends[-1]))]
                    offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
                    blobs = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)])
                    yield pa.record_batch([*(pa.array(c[x]) for c in (lists, docs_of, lo, comp, settled)), blobs], names)

    cut = materialize(map_batches(texts, contexts, "list long, doc long, lo long, comp long, settled boolean, tokens binary").withColumn("h", F.xxhash64("tokens")), "passage-contexts")
    discard(left)
    # equal contexts of a list are one class, led by its smallest document
    classes = materialize(cut.groupBy("list", "h").agg(F.min(F.struct("doc", "lo", "comp", "settled", "tokens")).alias("x")).select("list", "h", "x.*"), "passage-classes")
    heads = classes.select("list", "h", F.col("doc").alias("source_id"), F.col("comp").alias("home"))
    members = cut.join(heads, ["list", "h"]).where("doc > source_id and (not settled or comp <> home)")
    members = members.select(F.col("doc").alias("doc_id"), "source_id", F.col("lo").alias("begin_word"), (F.col("lo") + F.octet_length("tokens") / 4 + (SHINGLE - 1)).cast("long").alias("end_word"))
    out = materialize(members.distinct(), "passage-members")
    discard(cut)

    def compare(table: pa.Table) -> pa.Table:
        lists, i, j, block, doc, lo, comp, settled = (table.column(c).to_numpy() for c in ("list", "i", "j", "block", "doc", "lo", "comp", "settled"))
        blobs = table.column("tokens").to_pylist()
        order = np.lexsort((settled, lo, doc, j, i, lists))
        key = np.stack((lists, i, j))[:, order]
        cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            if b - a < 2 or (i[own[0]] != j[own[0]] and block[own].min() == block[own].max()):
                continue
            tokens = [np.frombuffer(blobs[x], np.uint32) for x in own]
            rows += [(doc[own[x]], doc[own[y]], lo[own[x]] + p, lo[own[x]] + q + SHINGLE) for x, y, p, q in context_links(doc[own], comp[own], settled[own].astype(bool), block[own], tokens, t)]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "source_id", "begin_word", "end_word"])

    rounds, crowds = dealt_contexts(classes, t)
    for dealt in rounds:
        near = dealt.groupBy(part(buckets * 4, "list", "i", "j")).applyInArrow(lambda table: compare(table), "doc_id long, source_id long, begin_word long, end_word long")
        out = out.union(materialize(near.distinct(), "passage-more"))
    discard(classes, crowds)
    return out.distinct()


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first, end exclusive) and the blanks between these."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, len(places))
        if a >= b:
            continue
        if places[a][0] > at:
            out.append(text[at:places[a][0]])
        at = max(at, places[b - 1][1])
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Documents without the passages that repeat a document with a smaller id; those left without words go.

    The first document keeps its passage. Columns stay; ``n_chars``, if named, is counted anew.
    """
    spans = repeated_passages(docs, LEAST_WORDS, doc_id, text).where("doc_id > source_id").groupBy("doc_id").agg(F.collect_set(F.struct("begin_word", "end_word")).alias("_tg_spans"))
    spans = materialize(spans.withColumnRenamed("doc_id", doc_id), "passage-spans")
    joined = docs.join(spans, doc_id, "left").select(*docs.columns, "_tg_spans")
    schema, columns = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(text).to_pylist(), []
            for i, s in enumerate(batch.column("_tg_spans").to_pylist()):
                if s:
                    texts[i] = cut_words(texts[i] or "", [(x["begin_word"], x["end_word"]) for x in s])
                keep.append(not s or bool(_WORD.search(texts[i])))
            cols = {c: batch.column(c) for c in columns}
            cols[text] = pa.array(texts, pa.string())
            if n_chars in cols:
                cols[n_chars] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.column(n_chars).type)
            yield pa.record_batch(list(cols.values()), list(cols)).filter(pa.array(keep, pa.bool_()))

    from .support import ship_package

    ship_package(docs.sparkSession)
    return joined.mapInArrow(run, schema)
