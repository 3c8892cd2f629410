"""Elias-Fano sequences over numpy arrays, in memory-mapped files, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the (k + 1)-th set bit of each byte value.
_SELECT = np.array([[next((b for b in range(8) if (v >> b) & 1 and bin(v & ((1 << b) - 1)).count("1") == k), 8) for k in range(8)] for v in range(256)], np.uint8)


def _bits_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Fields of `width` bits that start at the given bits of little-endian words (one spare word follows)."""
    if not width:
        return np.zeros(len(at), _U)
    word, shift = (at >> 6).astype(np.int64), (at & 63).astype(_U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << width) - 1)


class EliasFano:
    """A sorted sequence of n integers: `low_bits` bits of each are stored as they are, the others in unary.

    Arrays: low (bit-packed words), high (unary words), ones and zeros before each high word (for select).
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank

    @classmethod
    def build(cls, values: np.ndarray, universe_bits: int) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        low_bits = max(0, universe_bits - max(n, 1).bit_length() + 1)
        low_bits = min(low_bits, 63)
        low = np.zeros((n * low_bits >> 6) + 2, _U)
        if low_bits and n:
            field = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(low, word, field << shift)
            over = shift + _U(low_bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, field[over] >> (_U(64) - shift[over]))
        top = (values >> _U(low_bits)).astype(np.int64)
        ones = top + np.arange(n)
        size = (int(ones[-1]) if n else 0) + 2
        bits = np.zeros(-(-(size + 64) // 64) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        per_word = _POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return cls(n, low_bits, low, high, np.concatenate([[0], np.cumsum(per_word)]))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.rank]

    def _in_word(self, word: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        b = self.high[word]
        b = np.ascontiguousarray(~b if flip else b).view(np.uint8).reshape(-1, 8)
        cum = np.cumsum(_POP[b], axis=1, dtype=np.int64)
        byte = (cum <= k[:, None]).sum(axis=1)
        row = np.arange(len(word))
        before = np.where(byte > 0, cum[row, np.maximum(byte - 1, 0)], 0)
        return byte * 8 + _SELECT[b[row, byte], k - before]

    def _select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.rank, k, "right") - 1
        return word * 64 + self._in_word(word, k - self.rank[word], False)

    def _after_zeros(self, k: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below k (k up to the largest high part)."""
        zeros = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank
        want = k - 1
        word = np.searchsorted(zeros, np.maximum(want, 0), "right") - 1
        place = word * 64 + self._in_word(word, np.maximum(want, 0) - zeros[word], True)
        return np.where(k > 0, place - want, 0)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, _U)
        return ((self._select1(i) - i).astype(_U) << _U(self.low_bits)) | _bits_at(self.low, i * self.low_bits, self.low_bits)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is not below x (n if there is none)."""
        x = np.asarray(x, _U)
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64)
        top, low = (x >> _U(self.low_bits)).astype(np.int64), x & _U((1 << self.low_bits) - 1)
        last = int(self.get(np.array([self.n - 1]))[0] >> _U(self.low_bits))
        beyond = top > last
        top = np.minimum(top, last)
        at, end = self._after_zeros(top), self._after_zeros(np.minimum(top + 1, last + 1))
        end = np.where(top == last, self.n, end)
        active = np.flatnonzero(~beyond & (at < end))
        while len(active):  # halves what is left of each bucket
            mid = (at[active] + end[active]) >> 1
            below = _bits_at(self.low, mid * self.low_bits, self.low_bits) < low[active]
            at[active[below]] = mid[below] + 1
            end[active[~below]] = mid[~below]
            active = active[at[active] < end[active]]
        return np.where(beyond, self.n, at)
