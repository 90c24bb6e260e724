"""Suffix arrays by induced sorting, and permuted common prefixes, over one shard of bytes.

Induced sorting classifies suffixes as larger (L) or smaller (S) than their neighbour to the right. The leftmost S suffixes of each
run are sorted by their substrings, those by the order of their names; all others follow in two linear passes, bucket by
bucket. Within a bucket the passes go in waves, each of which is a few numpy operations.
"""

from __future__ import annotations

import numpy as np


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that an order of the leftmost-smaller suffixes leads to. `s` ends with its only 0."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(len(s), -1, np.int64)
    present = np.flatnonzero(counts).tolist()
    order = leftmost[np.argsort(s[leftmost], kind="stable")]
    edges = np.searchsorted(s[order], np.arange(size + 1))

    def by_bucket(places):
        chars = s[places]
        group = np.argsort(chars, kind="stable")
        chars = chars[group]
        sizes = np.bincount(chars, minlength=size)
        return places[group], chars, np.arange(len(chars)) - (np.cumsum(sizes) - sizes)[chars], sizes

    def push_larger(wave):
        before = wave[wave > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            before, chars, nth, sizes = by_bucket(before)
            sa[head[chars] + nth] = before
            head[:] += sizes

    def push_smaller(wave):
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            before, chars, nth, sizes = by_bucket(before)
            sa[tail[chars] - 1 - nth] = before
            tail[:] -= sizes

    head = heads.copy()
    for c in present:
        low = heads[c]
        while low < head[c]:
            low, high = head[c], low
            push_larger(sa[high:low])
        push_larger(order[edges[c] : edges[c + 1]])
    tail = ends.copy()
    for c in reversed(present):
        high = ends[c]
        while high > tail[c]:
            high, low = tail[c], high
            push_smaller(sa[high:low][::-1])
        push_smaller(sa[heads[c] : head[c]][::-1])
    sa[0] = len(s) - 1
    return sa


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet: what is still equal is told apart by what follows, twice as far each time."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step, at = 1, np.arange(n)
    while True:
        last = np.append(new[1:], True)
        tied = ~(new & last)[at]
        at = at[tied]
        if not len(at):
            return order
        places = order[at]
        behind = places + step
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        sort = np.lexsort((second, rank[places]))
        places, first, second = places[sort], rank[places][sort], second[sort]
        order[at] = places
        split = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[at] = split
        rank[places] = np.maximum.accumulate(np.where(split, at, 0))
        step *= 2


def _named(s: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the substrings from each place to the next, in text order, given the places in order of the substrings."""
    following = np.full(len(s), len(s) - 1)
    following[places[:-1]] = places[1:]
    a, b = order[:-1], order[1:]
    lengths = following[order] - order
    differ = lengths[1:] != lengths[:-1]
    live, offset, length = np.flatnonzero(~differ), 0, lengths[1:]
    while len(live):
        unequal = s[a[live] + offset] != s[b[live] + offset]
        differ[live[unequal]] = True
        offset += 1
        live = live[~unequal & (length[live] >= offset)]
    names = np.empty(len(s), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(differ)])
    return names[places]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Where the suffixes of a run of bytes begin, in order."""
    if len(data) < 2:
        return np.arange(len(data))
    s = np.zeros(len(data) + 1, np.uint16)
    s[:-1] = data.astype(np.uint16) + 1
    # a symbol equal to its right neighbour is of its type: that of the end of its run
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
    kind = np.append(s[ends[:-1]] < s[ends[:-1] + 1], True)
    smaller = np.repeat(kind, np.diff(np.concatenate([[-1], ends])))
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    first = _induce(s, smaller, leftmost, 257)
    names = _named(s, leftmost, first[is_leftmost[first]])
    return _induce(s, smaller, leftmost[_sorted_names(names)], 257)[1:]


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in the text, how many bytes its suffix shares with the one before it in order.

    Only where the bytes in front of both differ, the prefixes are compared, eight bytes at a time; from such a place on, the length
    falls by one with each byte.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    inner = np.flatnonzero((before[1:] > 0) & (before[:-1] >= 0)) + 1
    fresh[inner] = data[inner - 1] != data[before[inner] - 1]
    fresh[np.flatnonzero(before < 0)] = True
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + 8,), (1,))
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    while len(live):
        a, b = live + shared[live], before[live] + shared[live]
        apart = (eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]).astype("<u8")
        equal = (apart[:, None].view(np.uint8) != 0).argmax(axis=1)
        equal[apart == 0] = 8
        room = np.minimum(n - a, n - b)
        shared[live] += np.minimum(equal, room)
        live = live[(equal == 8) & (room > 8)]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(shared[start] - (np.arange(n) - start), 0)
