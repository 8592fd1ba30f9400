"""Minimisers, super-k-mers and exact sorting of their windows, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """64-bit hash of any range of a sequence, by prefix sums."""

    def __init__(self, values: np.ndarray):
        p, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.inverse[a]
        h ^= h >> U(32)
        h *= _ODD
        return h ^ (h >> U(29))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the first among equals.

    The place takes the low 24 bits of the key, so a call takes at most 2**24 keys; what is
    left of the hash decides, and equal rests are settled by place, the same wherever the
    window's content occurs.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U((1 << 24) - 1)
    m = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return (m[:n] & low).astype(np.int64)


def runs(place: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of good windows with one minimiser."""
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = good.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
    start = np.flatnonzero(new)
    stop = good.copy()
    stop[:-1] &= (place[1:] != place[:-1]) | ~good[1:]
    return start, np.flatnonzero(stop) - start + 1


def gather(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (counts[0] of them), first[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total)


def classes(hashes: np.ndarray, values: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """First place of each class of equal ranges, and each range's class.

    Ranges of one hash are compared value by value, so the classes are exact; should ranges of
    one hash differ, all are told apart by their values.
    """
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[of]
    rows = np.flatnonzero(like != np.arange(len(like)))
    for at in range(0, len(rows), block):
        a = rows[at : at + block]
        b, n = like[a], size[a]
        if (n != size[b]).any() or (values[gather(start[a], n)] != values[gather(start[b], n)]).any():
            seen: dict[bytes, int] = {}
            of = np.array([seen.setdefault(values[s : s + z].tobytes(), len(seen)) for s, z in zip(start.tolist(), size.tolist())], np.int64)
            return np.unique(of, return_index=True)[1], of
    return first, of


def sort_rows(word, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their words, most significant first, and whether each sorted row equals the one before.

    ``word(j, rows)`` gives the rows' j-th 64-bit word. A row that already differs from all
    others leaves; only ties go on to the next word.
    """
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # first sorted place of the row's tie group, by sorted place
    live = np.arange(n)
    for j in range(depth):
        if not len(live):
            break
        rows = order[live]
        w = word(j, rows)
        o = np.lexsort((w, group[live]))
        order[live] = rows[o]
        w = w[o]
        g = group[live]  # places of one group are contiguous, so the groups keep their places
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(live)))
        group[live] = np.repeat(live[at], size)
        live = live[np.repeat(size > 1, size)]
    same = np.zeros(n, bool)
    same[1:] = group[1:] == group[:-1]
    return order, same


def shared(hashes: np.ndarray) -> np.ndarray:
    """True where a value occurs more than once."""
    order = np.argsort(hashes)
    h = hashes[order]
    eq = h[1:] == h[:-1]
    out = np.zeros(len(h), bool)
    out[1:] |= eq
    out[:-1] |= eq
    back = np.empty(len(h), bool)
    back[order] = out
    return back
