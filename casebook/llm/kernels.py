"""Vectorised text kernels on Arrow buffers: no Python string is made per word.

A block is a run of whole documents of about ``BLOCK`` bytes (a longer document is a block of its own), so the
working arrays are bounded by the block or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``size`` bytes."""
    data, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Powers:
    """Powers of the hash base and of its inverse mod 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * BLOCK)
            inverse = pow(_P, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(m - 1, _P, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(m - 1, inverse, np.uint64)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class PrefixHash:
    """Polynomial hashes mod 2^64 of any byte spans of a block, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of ``inside``, cut at document limits."""
    n = len(inside)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    data = ASCII_LOWER[data]
    start, end, doc = spans(~_SPACE[data], off)
    return PrefixHash(data).of(start, end), doc


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``k``-word shingles; with fewer words the whole sequence is
    one shingle, without words the set is empty."""
    h, doc = words(data, off)
    first = np.searchsorted(doc, np.arange(len(off)))
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            roll = mix(roll * _U(_P) + h[i:i + len(roll)])
    out = []
    for i in range(len(off) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(roll[a:b - k + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = mix(whole * _U(_P) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
