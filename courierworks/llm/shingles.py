"""Hashes over byte buffers that hold many texts: substrings, words and word shingles, all in numpy."""

from __future__ import annotations

import numpy as np

from courierworks.llm.common import HASH_BYTES, memory

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
KEPT = HASH_BYTES + 1  # powers that a worker remembers; longer texts get tables of their own


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    held = memory("powers")
    if "tables" not in held or len(held["tables"][0]) < n:
        size = min(KEPT, max(1 << 16, 1 << (n - 1).bit_length())) if n <= KEPT else n
        tables = []
        for base in (BASE, BASE_INVERSE):
            table = np.full(size, base)
            table[0] = 1
            tables.append(np.cumprod(table, out=table))
        if n > KEPT:
            return tables[0], tables[1]
        held["tables"] = tables
    up, down = held["tables"]
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of a byte buffer, for `substring_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data))[0], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each substring; equal substrings have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(data: np.ndarray, doublings: int) -> np.ndarray:
    """64-bit hashes of all substrings of 2**doublings bytes."""
    h = _VALUE[data]
    step = 1
    for _ in range(doublings):
        h = h[:-step] * np.uint64(pow(int(BASE), step, 1 << 64)) + h[step:]
        step *= 2
    return mix(h)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words before each text and in all): words are runs between ASCII white space."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = starts[starts < ends]
    first[begin] = inside[begin]
    finish = ends[starts < ends] - 1
    last[finish] = inside[finish]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.concatenate([np.searchsorted(at, starts), [len(at)]])
    return (substring_hash(prefix_sums(data), at, to) if len(at) else np.zeros(0, np.uint64)), bounds


def word_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word shingles of every text, ordered by text and hash; a shorter text has one, of all its words."""
    hashes, bounds = words(data, starts, ends)
    counts = np.diff(bounds)
    factors = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(size)]
    owners, out = [], []
    if len(hashes) >= size:
        n = len(hashes) - size + 1
        total = sum((hashes[i:i + n] * factors[i] for i in range(size)), np.zeros(n, np.uint64))
        text = np.repeat(np.arange(len(counts)), counts)
        whole = text[:n] == text[size - 1:size - 1 + n]
        owners.append(text[:n][whole])
        out.append(mix(total[whole]))
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        if len(short):
            total = sum((hashes[bounds[short] + i] * factors[i] for i in range(few)), np.zeros(len(short), np.uint64))
            owners.append(short)
            out.append(mix(total + np.uint64(few)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, value = np.concatenate(owners), np.concatenate(out)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]
