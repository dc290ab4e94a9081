"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Leftmost-smaller substrings are sorted and named, and the string of their names is sorted by the same
procedure; of names that occur once only those are kept that end another's comparison. Over few symbols
(bytes) a bucket is moved at once: runs of equal symbols, which would otherwise have to be followed one by
one, are laid out by their lengths. Over many (names) suffixes are induced one by one.
"""

from __future__ import annotations

import numpy as np

NONE = np.zeros(0, np.int32)


def _with_runs(items: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """items of a bucket, followed by what they induce in the bucket itself: the places before them in their runs, nearest first."""
    left = items - run_start[items]
    if not left.any():
        return items
    each = left + 1
    step = np.arange(each.sum(), dtype=np.int32) - np.repeat(np.cumsum(each) - each, each).astype(np.int32)
    return (np.repeat(items, each) - step)[np.argsort(step, kind="stable")].astype(np.int32)


def _induce(t: np.ndarray, run_start: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, given the leftmost-smaller places in order."""

    def deal(places: np.ndarray, into: list[list[np.ndarray]]) -> None:
        if len(places):
            symbol = t[places]
            order = np.argsort(symbol, kind="stable")
            count = np.bincount(symbol, minlength=size)
            at = np.concatenate([[0], np.cumsum(count)])
            places = places[order]
            for c in np.flatnonzero(count).tolist():
                into[c].append(places[at[c] : at[c + 1]])

    own: list[list[np.ndarray]] = [[] for _ in range(size)]
    deal(lms, own)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    left: list[np.ndarray] = []
    for c in range(size):  # suffixes that are larger than the next one, upwards
        items = _with_runs(np.concatenate(larger[c] or [NONE]), run_start)
        left.append(items)
        items = np.concatenate([items, *own[c]])
        before = items[(items > 0) & (items == run_start[items])] - 1
        deal(before[t[before] > c], larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    smaller[0].append(np.array([len(t) - 1], np.int32))
    right: list[np.ndarray] = [NONE] * size
    for c in range(size - 1, -1, -1):  # those that are smaller, downwards
        items = _with_runs(np.concatenate(smaller[c] or [NONE]), run_start)
        right[c] = items[::-1]
        items = np.concatenate([items, left[c][::-1]])
        before = items[(items > 0) & (items == run_start[items])] - 1
        deal(before[t[before] < c], smaller)
    return np.concatenate([x for c in range(size) for x in (left[c], right[c])])


def _equal_parts(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether t[a:a+length] equals t[b:b+length], for each."""
    same = np.ones(len(a), bool)
    at, rows = 0, np.arange(len(a))
    while len(rows):
        rows = rows[length[rows] > at]
        differ = t[a[rows] + at] != t[b[rows] + at]
        same[rows[differ]] = False
        rows = rows[~differ]
        at += 1
    return same


def _induce_each(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """As _induce, suffix by suffix: for alphabets as large as the text."""
    count = np.bincount(t, minlength=size)
    end = np.cumsum(count)
    symbols, smaller, out = t.tolist(), small.tolist(), [-1] * len(t)
    tail = end.tolist()
    for i in reversed(lms.tolist()):
        tail[symbols[i]] -= 1
        out[tail[symbols[i]]] = i
    head = (end - count).tolist()
    for k in range(len(out)):
        i = out[k] - 1
        if i >= 0 and not smaller[i]:
            out[head[symbols[i]]] = i
            head[symbols[i]] += 1
    tail = end.tolist()
    for k in range(len(out) - 1, -1, -1):
        i = out[k] - 1
        if i >= 0 and smaller[i]:
            tail[symbols[i]] -= 1
            out[tail[symbols[i]]] = i
    return np.array(out, np.int32)


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by recursion on the names that occur more than once and those right behind them."""
    often = np.bincount(names)[names] > 1
    keep = np.flatnonzero(often | np.concatenate([[False], often[:-1]]))
    rank = np.zeros(len(names), np.int64)
    if len(keep):
        values, dense = np.unique(names[keep], return_inverse=True)
        rank[keep[suffix_array(dense + 1, len(values) + 1)]] = np.arange(len(keep))
    return np.lexsort((rank, names))


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of text, an array of symbols 1..size-1; a symbol 0 is added at the end and left out of the result."""
    t = np.append(text, 0).astype(np.uint16 if size < 1 << 16 else np.int32)
    n = len(t)
    place = np.arange(n, dtype=np.int32)
    change = np.flatnonzero(t[1:] != t[:-1]).astype(np.int32)
    run_start = np.zeros(n, np.int32)
    run_start[change + 1] = change + 1
    run_start = np.maximum.accumulate(run_start)
    last = change[np.minimum(np.searchsorted(change, place[:-1]), len(change) - 1)]  # last place of the run
    small = np.append(t[last] < t[last + 1], True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    few = size <= 512 or size < n >> 8

    def induce(order: np.ndarray) -> np.ndarray:
        return _induce(t, run_start, order, size) if few else _induce_each(t, small, order, size)

    first = induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # name the substrings from one such place to the next
    index = np.zeros(n, np.int32)
    index[lms] = np.arange(len(lms))
    length = np.append(lms[1:] - lms[:-1] + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    la, lb = length[index[a]], length[index[b]]
    same = (la == lb) & (b != n - 1) & (a != n - 1)
    rows = np.flatnonzero(same)
    same[rows] = _equal_parts(t, a[rows], b[rows], la[rows])
    name = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(len(lms), np.int64)
    names[index[ordered]] = name
    if name[-1] + 1 < len(lms):
        ordered = lms[_sorted_names(names)]
    return induce(ordered)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, stride: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, before): for every place, in the order of the text, the length up to `most` of what its suffix shares with the one before it in the suffix array, and where that one starts (-1: none).

    A place shares at most one byte less than the place before it does, so every `stride`-th is counted
    from the start and the others from that bound.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    eights = np.ndarray((n + 1,), "<u8", padded.data, 0, (1,))
    top = most + stride
    prefix = np.zeros(n, np.int32)

    def count(rows: np.ndarray) -> None:
        rows = rows[before[rows] >= 0]
        while len(rows):
            a, b = rows + prefix[rows], before[rows] + prefix[rows]
            left = n - np.maximum(a, b)
            x = eights[np.minimum(a, n)] ^ eights[np.minimum(b, n)]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8).astype(np.int32)
            same = np.minimum(same, left)
            prefix[rows] += same
            rows = rows[(same == 8) & (prefix[rows] < top)]

    count(np.arange(0, n, stride))
    bound = np.repeat(prefix[::stride], stride)[:n] - np.arange(n, dtype=np.int32) % stride
    prefix = np.maximum(np.where(before >= 0, bound, 0), 0).astype(np.int32)
    count(np.flatnonzero(prefix < most))
    return np.minimum(prefix, most), before
