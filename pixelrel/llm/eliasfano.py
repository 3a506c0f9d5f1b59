"""Monotone sequences in Elias-Fano form, read from memory-mapped levels by whole arrays of queries."""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64
_PAIRS, _QUADS, _OCTETS, _EACH, _TOPS = (U(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
#: Position of the r-th set bit of a byte.
_SELECT = np.array([[*[k for k in range(8) if b >> k & 1], *[8] * (8 - b.bit_count())] for b in range(256)], np.uint8)


def mapped(array: np.ndarray) -> np.ndarray:
    """``array`` in a memory-mapped file that is gone once it is released: the system may drop its pages and read them again."""
    if not array.nbytes:
        return array
    file = tempfile.TemporaryFile()
    array.tofile(file)
    file.flush()
    return np.memmap(file, array.dtype, "r", shape=array.shape)


class Bits:
    """A bit vector with the number of ones before each 64-bit word."""

    def __init__(self, ones: np.ndarray, size: int):
        """Ones at the strictly rising positions ``ones`` of ``size`` bits."""
        words = np.zeros((size >> 6) + 1, U)
        if len(ones):
            at = ones >> U(6)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            words[at[first].astype(np.int64)] = np.bitwise_or.reduceat(U(1) << (ones & U(63)), first)
        self.words = mapped(words)
        before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
        self.before = mapped(before.astype(np.uint32) if size < 1 << 32 else before)

    def select(self, k: np.ndarray, one: bool = True) -> np.ndarray:
        """Position of the k-th one (or zero), counted from 0."""
        before = self.before if one else np.arange(len(self.before)) * 64 - self.before.astype(np.int64)
        at = np.searchsorted(before, k, "right") - 1
        word, left = np.asarray(self.words[at]), (k - before[at]).astype(U)
        if not one:
            word = ~word
        # Ones of each byte, then of it and those below it, eight counts side by side in one number.
        ones = word - (word >> U(1) & _PAIRS)
        ones = (ones & _QUADS) + (ones >> U(2) & _QUADS)
        upto = ((ones + (ones >> U(4))) & _OCTETS) * _EACH
        octet = np.bitwise_count(((left * _EACH | _TOPS) - upto) & _TOPS).astype(U) << U(3)
        left -= (upto << U(8)) >> octet & U(255)
        return at * 64 + (octet.astype(np.int64) + _SELECT[(word >> octet & U(255)).astype(np.int64), left.astype(np.int64)])


class EliasFano:
    """``values``, never falling and below ``universe``: low bits side by side, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        values, n = values.astype(U), len(values)
        self.size, self.width = n, max(0, (int(universe) // max(n, 1)).bit_length() - 1)
        width, at = U(self.width), np.arange(n, dtype=U) * U(self.width)
        low, words = values & self._mask, np.zeros((n * self.width >> 6) + 2, U)
        if n and self.width:
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[first]] = np.bitwise_or.reduceat(low << shift, first)
            over = shift + width > U(64)
            words[word[over] + 1] |= low[over] >> (U(64) - shift[over])
        self.low = mapped(words)
        self.top = int(values[-1] >> width) if n else 0
        self.high = Bits((values >> width) + np.arange(n, dtype=U), n + self.top + 1)

    @property
    def _mask(self) -> np.uint64:
        return U((1 << self.width) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        rest = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (self.low[word] >> shift | rest) & self._mask

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.high.select(i) - i).astype(U) << U(self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value not below each x; the size where there is none."""
        high = (x >> U(self.width)).astype(np.int64)
        out = np.full(len(x), self.size)
        near = np.flatnonzero(high <= self.top) if self.size else np.empty(0, np.int64)
        h, want = high[near], x[near] & self._mask
        end = self.high.select(h, one=False) - h
        i = np.zeros(len(h), np.int64)
        later = h > 0
        i[later] = self.high.select(h[later] - 1, one=False) - (h[later] - 1)
        # Halving: a bucket may hold all followers of a common context.
        open_ = np.flatnonzero(i < end)
        while len(open_):
            middle = (i[open_] + end[open_]) >> 1
            less = self._low(middle) < want[open_]
            i[open_] = np.where(less, middle + 1, i[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[i[open_] < end[open_]]
        out[near] = i
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it is missing."""
        i = self.successor(x)
        inside = np.flatnonzero(i < self.size)
        out = np.full(len(x), -1)
        same = self.get(i[inside]) == x[inside]
        out[inside[same]] = i[inside[same]]
        return out
