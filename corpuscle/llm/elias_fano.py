"""Elias-Fano coding of ascending integers, with a select structure.

A value of n ascending integers below u keeps its low ``l = floor(log2(u / n))`` bits as they are; the high
parts are a bit vector in which the i-th one stands at (value >> l) + i. That is at most 2 + log2(u / n) bits a
value. ``select`` finds the i-th one from sampled counts of ones: one directory entry every SAMPLE words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 8  # 64-bit words for each directory entry
_HEAD = struct.Struct("<QQB")


def encode(values: np.ndarray) -> bytes:
    """values: ascending, not negative."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0)
    top = int(values[-1])
    l = max(0, ((top + 1) // n).bit_length() - 1)
    high = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-(int(high[-1]) + 1) // 64) * 64, np.uint8)
    bits[high] = 1
    upper = np.packbits(bits, bitorder="little")
    counts = np.bitwise_count(upper.view("<u8")).astype(np.int64)
    before = (np.cumsum(counts) - counts)[::SAMPLE].astype("<u4" if n < 1 << 32 else "<u8")
    lows = b""
    if l:
        plane = (values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(plane.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return _HEAD.pack(n, len(upper) // 8, l) + upper.tobytes() + before.tobytes() + lows


class EliasFano:
    """Reads what encode() wrote; ``size`` is the number of bytes it took."""

    def __init__(self, raw, at: int = 0):
        self.n, words, self.l = _HEAD.unpack_from(raw, at)
        at0, at = at, at + _HEAD.size
        self.words = np.frombuffer(raw, np.uint8, words * 8, at).view("<u8")
        at += words * 8
        kind = np.dtype("<u4" if self.n < 1 << 32 else "<u8")
        self.before = np.frombuffer(raw, np.uint8, -(-words // SAMPLE) * kind.itemsize, at).view(kind)
        at += self.before.nbytes
        self.lows = np.frombuffer(raw, np.uint8, -(-self.n * self.l // 8), at)
        self.size = at + self.lows.nbytes - at0

    def select(self, i) -> np.ndarray:
        """The i-th values (i: one position or an array of them)."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) == 0:
            return np.zeros(0, np.int64)
        word = (np.searchsorted(self.before, i, "right") - 1) * SAMPLE
        left = i - self.before[word // SAMPLE].astype(np.int64)
        for _ in range(SAMPLE - 1):
            ones = np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)]).astype(np.int64)
            step = left >= ones
            left, word = np.where(step, left - ones, left), word + step
        x, bit = self.words[word].copy(), np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = x & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = left >= ones
            left = np.where(up, left - ones, left)
            x = np.where(up, x >> np.uint64(width), part)
            bit += width * up
        value = (word * 64 + bit - i) << self.l
        for k in range(self.l):
            at = i * self.l + k
            value |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return value
