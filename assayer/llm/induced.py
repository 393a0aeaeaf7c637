"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor. The substrings between
leftmost-S positions are sorted by induction, named, and the string of names is sorted; that gives
the order of the leftmost-S suffixes, from which all others are induced in linear time. Induction
goes bucket by bucket over the alphabet: within a bucket, waves follow runs of one symbol, and what
a bucket induces goes to the other buckets in one stable routing step.
"""

from __future__ import annotations

import numpy as np

#: Strings of names over a larger alphabet have hardly a symbol twice in a bucket; they are sorted by doubling ranks.
BUCKETS = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last (the unique least symbol) counts as smaller."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    where = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    smaller = np.empty(n, bool)
    smaller[:-1] = step[np.minimum(nearest, max(n - 2, 0))] > 0
    smaller[-1] = True
    return smaller


def _route(lists: list[list[np.ndarray]], items: np.ndarray, symbol: np.ndarray) -> None:
    if not len(items):
        return
    order = np.argsort(symbol, kind="stable")
    items, symbol = items[order], symbol[order]
    cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1], [True]])).tolist()
    for a, b in zip(cut[:-1], cut[1:]):
        lists[symbol[a]].append(items[a:b])


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, induced from leftmost-S ones in the given order."""
    none = np.empty(0, lms.dtype)
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _route(seeds, lms, t[lms])
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    full_l = [none] * sigma
    for c in range(sigma):
        wave = np.concatenate(larger[c]) if larger[c] else none
        waves = []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]  # a run of c: larger as its successor is
        own = full_l[c] = np.concatenate(waves) if waves else none
        every = np.concatenate([own, *seeds[c]])
        before = every[every > 0] - 1
        before = before[~smaller[before]]
        symbol = t[before]
        go = symbol > c
        _route(larger, before[go], symbol[go])
    least: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    out = []
    for c in range(sigma - 1, -1, -1):
        wave = np.concatenate(least[c]) if least[c] else none
        waves = []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & smaller[before]]
        own = np.concatenate(waves) if waves else none
        if c == 0:
            own = np.array([len(t) - 1], lms.dtype)
        every = np.concatenate([own, full_l[c][::-1]])
        before = every[every > 0] - 1
        before = before[smaller[before]]
        symbol = t[before]
        go = symbol < c
        _route(least, before[go], symbol[go])
        out.append(every)
    return np.concatenate(out)[::-1]


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Suffix array of a string of ranks by doubling; groups that are settled take no part any more."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    fresh = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    place = np.empty(n, np.int64)
    place[order] = head
    h = 1
    while True:
        open_ = ~(fresh & np.append(fresh[1:], True))
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        own = order[at]
        after = np.where(own + h < n, place[np.minimum(own + h, n - 1)] + 1, 0)
        key = place[own] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[at], key = own[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[at] = new
        head = np.maximum.accumulate(np.where(new, at, 0))
        place[order[at]] = head
        h *= 2


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """t: symbols from 0 to sigma - 1; the last is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        order = _induce(t, smaller, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = order[is_lms[order]]
        # Names: equal neighbours in the order get one. Equality by length, and by hash of symbols.
        stop = np.append(lms[1:] + 1, n)
        number = np.empty(n, np.int64)
        number[lms] = np.arange(len(lms))
        mark = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
        mark *= np.uint64(0xBF58476D1CE4E5B9)
        up = np.full(n, 0xD1342543DE82EF95, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        down = np.full(n, pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mark * up)])
        hashes = (total[stop] - total[lms]) * down[lms] + (stop - lms).astype(np.uint64)
        seq = hashes[number[ordered]]
        name = np.cumsum(np.concatenate([[False], seq[1:] != seq[:-1]]))
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ordered]] = name
        names = int(name[-1]) + 1
        if names == len(lms):
            lms = ordered
        elif names <= BUCKETS:
            lms = lms[suffix_array(reduced, names)]
        else:
            lms = lms[_doubled(reduced)]
    return _induce(t, smaller, lms, sigma)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the symbols it has in common with its predecessor in the suffix array, ``most`` at most.

    Only irreducible values are compared symbol by symbol (eight at a time); every other one is its left neighbour's less one.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (t[:-1] == t[np.maximum(before[1:] - 1, 0)])
    heads = np.flatnonzero(~reducible)
    lcp = np.zeros(n, np.int64)
    raw = np.concatenate([t.astype(np.uint16), np.zeros(8, np.uint16)])  # padding equals the last symbol only
    four = raw[:-3].astype(np.uint64) | raw[1:-2].astype(np.uint64) << np.uint64(16) | raw[2:-1].astype(np.uint64) << np.uint64(32) | raw[3:].astype(np.uint64) << np.uint64(48)
    live = heads[before[heads] >= 0]
    size = np.zeros(len(live), np.int64)
    i, j = live.copy(), before[live].copy()
    left = np.arange(len(live))
    while len(left):
        same = (i < n) & (j < n)
        same[same] = four[i[same]] == four[j[same]]
        same &= size[left] < most
        stop = left[~same]
        if len(stop):
            a, b = i[~same], j[~same]
            more = np.zeros(len(stop), np.int64)
            equal = np.ones(len(stop), bool)
            for k in range(4):
                equal &= (a + k < n) & (b + k < n)
                equal &= raw[np.minimum(a + k, n)] == raw[np.minimum(b + k, n)]
                more += equal
            size[stop] += more
        left, i, j = left[same], i[same] + 4, j[same] + 4
        size[left] += 4
    lcp[live] = size
    head = np.maximum.accumulate(np.where(reducible, 0, at))
    # A reducible value is at least its head's less the distance; exact unless cut at ``most``, which a long stretch
    # of heads at ``most`` would understate, so those are compared anew.
    out = lcp[head] - (at - head)
    cut = np.flatnonzero(reducible & (lcp[head] >= most))
    if len(cut):
        out[cut] = _compare(four, raw, cut, before[cut], n, most)
    return np.minimum(np.maximum(out, 0), most)


def _compare(four, raw, i, j, n, most):
    """Whether the capped common prefix reaches ``most``, by doubling over hashes of blocks of ``most`` symbols."""
    mark = (raw[:n].astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    mark ^= mark >> np.uint64(31)
    up = np.full(n, 0xD1342543DE82EF95, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mark * up)])
    fits = (i + most <= n) & (j + most <= n)
    a, b = np.minimum(i + most, n), np.minimum(j + most, n)
    same = fits & ((total[a] - total[i]) * down[np.minimum(i, n - 1)] == (total[b] - total[j]) * down[np.minimum(j, n - 1)])
    return np.where(same, most, 0)
