"""Elias-Fano coding of non-decreasing integers, searched many values at a time.

A sequence of n values below a bound keeps the low bits of each value packed, and
the high bits as a unary bit row: bit (high + index) is set for each value. The bit
row has a running count of ones at each 64-bit word; select finds the word by binary
search and the bit by the running counts of its bytes. All arrays may be memory-mapped.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit in a byte, by rule.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _NTH[_b, _k] = _i
U64 = np.uint64
_PAIRS, _QUADS, _NIBBLES = U64(0x5555555555555555), U64(0x3333333333333333), U64(0x0F0F0F0F0F0F0F0F)
_EACH, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values of `width` bits each, end to end, in 64-bit words (one spare)."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * U64(width)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        np.bitwise_or.at(words, word, values << shift)
        spill = shift + U64(width) > U64(64)
        np.bitwise_or.at(words, word[spill] + 1, values[spill] >> (U64(64) - shift[spill]))
    return words


def encode(values: np.ndarray, bound: int) -> dict[str, np.ndarray]:
    """values: non-decreasing, each below bound."""
    n = len(values)
    width = max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> U64(width)).astype(np.int64)
    bits = np.zeros(((n + (bound >> width) + 2) // 64 + 1) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    ones = _ONES[packed].reshape(-1, 8).sum(axis=1, dtype=np.uint64)
    low = values & U64((1 << width) - 1)
    return {"head": np.array([n, width], np.uint64), "low": _pack(low, width), "high": packed.view(np.uint64), "rank": np.concatenate([[U64(0)], np.cumsum(ones)[:-1]]).astype(np.uint64)}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in parts["head"])
        self.words, self.high, self.rank = parts["low"], parts["high"], parts["rank"]
        self.mask = U64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) set, or unset, bit."""
        counts = self.rank if ones else np.arange(len(self.rank), dtype=np.uint64) * U64(64) - self.rank
        k = k.astype(np.uint64)
        word = np.searchsorted(counts, k, "right") - 1
        left = k - counts[word]
        bits = self.high[word] if ones else ~self.high[word]
        # running counts of the word's bytes, each in its own byte
        x = bits - ((bits >> U64(1)) & _PAIRS)
        x = (x & _QUADS) + ((x >> U64(2)) & _QUADS)
        upto = ((x + (x >> U64(4))) & _NIBBLES) * _EACH
        byte = ((((left * _EACH) | _TOPS) - upto) & _TOPS) >> U64(7)
        at = ((byte * _EACH) >> U64(56)) << U64(3)  # bytes whose running count is not above left
        before = ((upto << U64(8)) >> at) & U64(255)
        return word * 64 + at.astype(np.int64) + _NTH[(bits >> at) & U64(255), (left - before).astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * U64(self.width)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        value = self.words[word] >> shift
        upper = np.where(shift > 0, self.words[word + 1] << (U64(64) - np.maximum(shift, U64(1))), U64(0))
        return (value | upper) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << U64(self.width)) | self._low(i)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """First position whose value is not below each value; n if there is none."""
        if not len(values) or not self.n:
            return np.zeros(len(values), np.int64)
        high = (values >> U64(self.width)).astype(np.int64)
        zeros = len(self.high) * 64 - self.n
        beyond = high + 1 >= zeros
        high = np.minimum(high, zeros - 2)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        end = self._select(high, False) - high
        want = values & self.mask
        while (open_ := begin < end).any():  # binary search among equal high parts
            middle = (begin + end) // 2
            below = np.zeros(len(values), bool)
            below[open_] = self._low(middle[open_]) < want[open_]
            begin = np.where(open_ & below, middle + 1, begin)
            end = np.where(open_ & ~below, middle, end)
        return np.where(beyond, self.n, begin)
