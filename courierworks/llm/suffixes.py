"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting scans the array once per direction and lets each suffix place the one before it. A stretch of the scan that places nothing
into itself can be handled at once, so the scan runs over such stretches instead of single entries; order inside a bucket stays that of the
scan. Leftmost-smaller substrings are sorted by the same induction, named, and where names repeat the string of names is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def _smaller(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end counts as smaller than everything."""
    n = len(x)
    differs = np.flatnonzero(x[:-1] != x[1:])
    out = np.zeros(n, bool)
    if len(differs):
        nxt = np.searchsorted(differs, np.arange(n))
        known = nxt < len(differs)
        at = differs[nxt[known]]
        out[known] = x[at] < x[at + 1]
    return out


def _place(sa: np.ndarray, ends: np.ndarray, position: np.ndarray, bucket: np.ndarray, step: int) -> None:
    """Append positions to their buckets, in order, moving the bucket pointers by `step`."""
    n = len(bucket)
    order = (bucket.astype(np.uint16, copy=False) if len(ends) <= 65536 else bucket).argsort(kind="stable")
    bucket = bucket[order]
    cuts = (bucket[1:] != bucket[:-1]).nonzero()[0]
    first = np.zeros(len(cuts) + 2, np.int64)
    first[1:-1] = cuts + 1
    first[-1] = n
    counts, first = first[1:] - first[:-1], first[:-1]
    own = bucket[first]
    end = ends[own]
    sa[step * np.arange(n) + (end - step * first).repeat(counts)] = position[order]
    ends[own] = end + step * counts


def _induce(x: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The array that `lms`, in the given order inside each bucket, induces."""
    n = len(x)
    sa = np.full(n, -1, np.int64)
    if len(lms):
        tails = stops - 1
        _place(sa, tails, lms[::-1], x[lms[::-1]], -1)
    heads = starts.copy()
    sa[heads[x[n - 1]]] = n - 1
    heads[x[n - 1]] += 1
    left = np.full(n + 1, -1, np.int16 if len(starts) < 1 << 15 else np.int32)  # bucket of the suffix before each, if this direction places it; the last entry stands for empty slots
    left[1:n] = np.where(smaller[:-1], -1, x[:-1])
    at, span = 0, 1024
    while at < n:
        stop = min(n, at + span)
        chunk = sa[at:stop]
        bucket = left[chunk]
        slot = (bucket >= 0).nonzero()[0]
        if len(slot):
            bucket, prior = bucket[slot], chunk[slot] - 1
            low = np.minimum.accumulate(heads[bucket])
            if low[-1] < stop:
                tight = (low[:-1] <= slot[1:] + at).nonzero()[0]
                stop = int(low[tight[0] if len(tight) else -1])
                inside = slot.searchsorted(stop - at)
                prior, bucket = prior[:inside], bucket[:inside]
            _place(sa, heads, prior, bucket, 1)
        span = min(1 << 17, 2 * span) if stop - at == span else max(64, 2 * (stop - at))
        at = stop
    sa[smaller[np.maximum(sa, 0)] & (sa >= 0)] = -1
    tails = stops - 1
    left[1:n] = np.where(smaller[:-1], x[:-1], -1)
    at, span = n, 1024
    while at > 0:
        stop = max(0, at - span)
        chunk = sa[stop:at][::-1]
        bucket = left[chunk]
        slot = (bucket >= 0).nonzero()[0]
        if len(slot):
            bucket, prior = bucket[slot], chunk[slot] - 1
            top = np.maximum.accumulate(tails[bucket])
            if top[-1] >= stop:
                tight = (top[:-1] >= at - 1 - slot[1:]).nonzero()[0]
                stop = int(top[tight[0] if len(tight) else -1]) + 1
                inside = slot.searchsorted(at - stop)
                prior, bucket = prior[:inside], bucket[:inside]
            _place(sa, tails, prior, bucket, -1)
        span = min(1 << 17, 2 * span) if at - stop == span else max(64, 2 * (at - stop))
        at = stop
    return sa


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of small non-negative integers."""
    n = len(x)
    if n < 2:
        return np.arange(n)
    x = x.astype(np.int64)
    sizes = np.bincount(x)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    smaller = _smaller(x)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(x, smaller, lms, starts, stops)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    name = _names(x, lms, ordered)
    if name[ordered[-1]] + 1 < len(lms):
        ordered = lms[suffix_array(name[lms])]
    return _induce(x, smaller, ordered, starts, stops)


def _names(x: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """By position: the rank of each leftmost-smaller substring among the distinct ones, given their order."""
    length = np.zeros(len(x), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = len(x) - lms[-1] + 1  # runs into the end: equal to no other
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    left = np.flatnonzero(same)
    offset = 0
    while len(left):
        left = left[length[a[left]] > offset]
        bad = x[a[left] + offset] != x[b[left] + offset]
        same[left[bad]] = False
        left = left[~bad]
        offset += 1
    name = np.zeros(len(x), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, fresh: np.ndarray, cap: int) -> np.ndarray:
    """For every text position, the common prefix with the suffix just before it in the array, exact up to `cap`.

    Only irreducible values are compared: where the characters before differ, or where `fresh` says that a new piece of text starts; all
    others are one less than their left neighbour's.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    bare = fresh | (before < 0)
    bare[0] = True
    inner = ~bare
    inner[0] = False
    where = at[inner]
    bare[where] = (before[where] == 0) | (text[where - 1] != text[before[where] - 1])
    chosen = at[bare & (before >= 0)]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(cap + 16, np.uint8)])
    word = np.ndarray((n + cap + 8,), "<u8", padded.tobytes(), strides=(1,))
    prefix = np.zeros(n, np.int64)
    left, offset = chosen, 0
    while len(left) and offset < cap:
        differ = word[left + offset] ^ word[np.minimum(before[left] + offset, n + cap)]
        equal = differ == 0
        part = left[~equal]
        if len(part):
            d = differ[~equal]
            low = d & (~d + np.uint64(1))
            prefix[part] = offset + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        left = left[equal]
        offset += 8
    prefix[left] = cap
    prefix = np.minimum(prefix, n - np.maximum(at, before))
    source = np.maximum.accumulate(np.where(bare, at, 0))
    return np.maximum(prefix[source] - (at - source), 0)
