"""Suffix arrays by induced sorting, as array operations, and common prefixes of neighbours.

Only the order by the first ``depth`` bytes is asked for: suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last one counts as larger than nothing."""
    n = len(s)
    rises = np.zeros(n, bool)
    rises[:-1] = s[:-1] < s[1:]
    ends = np.ones(n, bool)  # the last of a run of equal symbols decides for the run
    ends[:-1] = s[:-1] != s[1:]
    at = np.where(ends, np.arange(n), n - 1)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def _put(sa: np.ndarray, places: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Append suffixes, in their order, to the buckets of their symbols; ``places`` are the free places."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    counts = np.bincount(sorted_symbols, minlength=len(places))
    first = np.cumsum(counts) - counts
    rank = np.arange(len(order)) - first[sorted_symbols]
    sa[places[sorted_symbols] + step * rank] = suffixes[order]
    places += step * counts


def induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost smaller ones, bucket by bucket.

    Larger suffixes go to the heads of their buckets in one sweep upwards, smaller ones to the tails in
    one sweep downwards.  Within a bucket, runs of its own symbol are followed round by round.
    """
    sizes = np.bincount(s)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    sa = np.full(len(s), -1, np.int32)
    symbols = np.nonzero(sizes)[0]
    lms = np.split(leftmost, np.searchsorted(s[leftmost], np.arange(1, len(sizes))))
    free = heads.copy()
    if not smaller[-1]:  # the last suffix stands first in its bucket
        sa[free[s[-1]]] = len(s) - 1
        free[s[-1]] += 1
    for c in symbols:
        done = heads[c]
        while True:
            batch = sa[done : free[c]]
            done = free[c]
            if not len(batch):
                break
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            _put(sa, free, before, s[before], 1)
        before = lms[c][lms[c] > 0] - 1
        before = before[~smaller[before]]
        _put(sa, free, before, s[before], 1)
    ends, free = free, tails - 1
    for c in symbols[::-1]:
        done = tails[c] - 1
        while True:
            batch = sa[free[c] + 1 : done + 1][::-1]
            done = free[c]
            if not len(batch):
                break
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            _put(sa, free, before, s[before], -1)
        batch = sa[heads[c] : ends[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        _put(sa, free, before, s[before], -1)
    return sa


def _names(s: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of the sorted leftmost smaller substrings; equal ones share a rank."""
    a, b, size = order[:-1], order[1:], lengths[1:]
    same = lengths[:-1] == size
    open_ = np.nonzero(same)[0]
    k = 0
    while len(open_):
        equal = s[a[open_] + k] == s[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal & (size[open_] > k)]
    return np.concatenate([[0], np.cumsum(~same)])


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a reduced string by at least ``depth`` names."""
    rank, width = names.astype(np.int64), 1
    top = int(rank.max()) + 2
    while True:
        if top > len(rank) or width >= depth:
            return np.argsort(rank, kind="stable").astype(np.int32)
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - width)] = rank[width:] + 1
        pair = rank * (top + 1) + after
        order = np.argsort(pair, kind="stable")
        ranked = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank = np.empty_like(rank)
        rank[order] = ranked
        top, width = int(ranked[-1]) + 2, width * 2


def suffix_array(s: np.ndarray, depth: int, small: int = 1024) -> np.ndarray:
    """Suffixes of ``s`` (symbols from 0) in order of their first ``depth`` symbols.

    The leftmost smaller substrings are sorted by inducing and named; the string of names is sorted
    recursively while its alphabet is at most ``small``, by doubling ranks beyond that.
    """
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = suffix_types(s)
    places = np.nonzero(smaller[1:] & ~smaller[:-1])[0].astype(np.int32) + 1
    if not len(places):
        return induce(s, smaller, places)
    rough = induce(s, smaller, places[np.argsort(s[places], kind="stable")])
    is_place = np.zeros(n, bool)
    is_place[places] = True
    order = rough[is_place[rough]]
    length_at = np.zeros(n, np.int32)
    length_at[places] = np.diff(np.append(places, n)) + 1
    length_at[places[-1]] = n - places[-1]
    ranked = _names(s, order, length_at[order])
    name_at = np.zeros(n, np.int32)
    name_at[order] = ranked
    reduced = name_at[places]
    if ranked[-1] + 1 == len(places):
        sorted_places = order
    elif ranked[-1] < small and len(reduced) > small:
        sorted_places = places[suffix_array(reduced, max(1, depth // 2 + 1), small)]
    else:
        sorted_places = places[_by_doubling(reduced, depth // 2 + 1)]
    return induce(s, smaller, sorted_places)


def common_prefixes(s: np.ndarray, sa: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Permuted common prefixes: of each of ``places`` with its predecessor in ``sa``, up to ``depth``."""
    previous = np.full(len(s), -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    padded = np.concatenate([s.astype(np.uint16) + 1, np.zeros(depth + 1, np.uint16)])  # nothing equals the end
    padded[len(s)] = 0
    out = np.zeros(len(places), np.int32)
    open_ = np.nonzero(previous[places] >= 0)[0]
    a, b = places[open_], previous[places[open_]]
    for k in range(depth):
        equal = (padded[a + k] == padded[b + k]) & (padded[a + k] > 0)
        open_, a, b = open_[equal], a[equal], b[equal]
        if not len(open_):
            break
        out[open_] = k + 1
    return out
