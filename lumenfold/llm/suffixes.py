"""Suffix arrays by two-stage sorting, and adjacent common prefixes.

A suffix is "rising" if it is smaller than its successor, "falling" otherwise.
Only rising suffixes are sorted directly; the falling ones are induced: scanning
the array by first symbols upwards, each suffix places its predecessor, if that
is falling, next in its own bucket.

For the direct sort a suffix is read as a row of segments, each up to the next
rising place, or _REACH symbols on in a long fall. With each symbol goes
whether it rises (of suffixes with one first symbol the falling ones are
smaller), so no segment is the beginning of another, and the segments' numbers
can be sorted by doubling in place of the symbols.
"""

from __future__ import annotations

import numpy as np

from .grams import _A, mix64

_BITS, _REACH = 10, 5


def _rising(symbols: np.ndarray) -> np.ndarray:
    n = len(symbols)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(symbols[1:].astype(np.int16) - symbols[:-1])
    step[-1:] = -1
    change = np.flatnonzero(step)
    return step[change[np.searchsorted(change, np.arange(n))]] > 0


def _places(rising: np.ndarray) -> np.ndarray:
    """Where segments begin, and the end: rising places, and every _REACH symbols in the falls between."""
    at = np.flatnonzero(rising)
    gaps = np.diff(np.append(at, len(rising)))
    count = (gaps - 1) // _REACH + 1
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.append(np.repeat(at, count) + _REACH * inner, len(rising))


def _segments(symbols: np.ndarray, rising: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The segments from each bound to the next, both ends included, as numbers in their order."""
    typed = np.zeros(len(symbols) + _REACH + 1, np.int64)
    typed[: len(symbols)] = 2 * symbols.astype(np.int64) + rising
    begin, length = bounds[:-1], np.diff(bounds)
    out = np.zeros(len(begin), np.int64)
    for j in range(_REACH + 1):
        out = (out << _BITS) | typed[begin + j]
    beyond = _BITS * (_REACH - length)
    return out >> beyond << beyond


def _sorted_directly(keys: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the suffixes that begin at bounds, in order of their first depth symbols at least."""
    n = len(keys)
    rank = np.zeros(n + 1, np.int64)  # first place of the suffixes that are equal so far; 0 after the end
    order = np.argsort(keys)
    new = np.ones(n, bool)
    new[1:] = np.diff(keys[order]) != 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size) + 1
    tied, width = order[np.repeat(size, size) > 1], 1
    while len(tied):
        tied = tied[bounds[np.minimum(tied + width, n)] - bounds[tied] < depth]
        tied = tied[np.lexsort((rank[np.minimum(tied + width, n)], rank[tied]))] if n > 1 << 31 else tied[np.argsort(rank[tied] * (n + 1) + rank[np.minimum(tied + width, n)])]
        before, after = rank[tied], rank[np.minimum(tied + width, n)]
        old = np.ones(len(tied), bool)
        old[1:] = before[1:] != before[:-1]
        new = old.copy()
        new[1:] |= after[1:] != after[:-1]
        at = np.arange(len(tied))
        rank[tied] = before + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied, width = tied[~alone], 2 * width
    return np.argsort(rank[:n], kind="stable")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of symbols (0 to 511), sorted by their first depth symbols at least."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rising = _rising(symbols)
    bounds = _places(rising)
    direct = bounds[_sorted_directly(_segments(symbols, rising, bounds), bounds, depth)]
    direct = direct[rising[direct]]
    most = int(symbols.max()) + 1
    cuts = np.searchsorted(symbols[direct], np.arange(most + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(most)]
    waiting[symbols[-1]].append(np.array([n - 1]))
    out = []
    for c in range(most):
        bucket = waiting[c]
        level = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        falling = []
        while len(level):
            falling.append(level)
            before = level[level > 0] - 1
            level = before[(symbols[before] == c) & ~rising[before]]
        whole = np.concatenate([*falling, direct[cuts[c] : cuts[c + 1]]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[symbols[before] > c]
        first = symbols[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        at = np.flatnonzero(np.diff(first, prepend=-1))
        for part in np.split(before, at[1:]) if len(before) else []:
            waiting[symbols[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int, exact: bool = True) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, up to depth; 0 for the first.

    Lengths are found by halving: equal 64-bit hashes stand for equal strings.
    If not exact, prefixes short of depth are 0.
    """
    n = len(symbols)
    prefix = _A.prefix(mix64(symbols.astype(np.uint64) + np.uint64(1)))
    out = np.zeros(len(order), np.int64)
    pair = np.arange(1, len(order))
    pair = pair[symbols[order[pair - 1]] == symbols[order[pair]]]
    a, b, done = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    if not exact:
        fits = np.flatnonzero(np.maximum(a, b) + depth <= n)
        a, b = a[fits], b[fits]
        out[pair[fits]] = depth * (_A.spans(prefix, a, a + depth) == _A.spans(prefix, b, b + depth))
        return out
    step = 1 << (depth.bit_length() - 1)
    while step:
        for _ in range(2 if 2 * step > depth else 1):
            fits = (np.maximum(a, b) + done + step <= n) & (done + step <= depth)
            x, y, d = a[fits], b[fits], done[fits]
            done[fits] += step * (_A.spans(prefix, x + d, x + d + step) == _A.spans(prefix, y + d, y + d + step))
        step //= 2
    out[pair] = done
    return out
