"""A compressed FM-index over integer sequences: a wavelet matrix of the Burrows-Wheeler transform.

All queries run many at a time in numpy. Bit vectors are packed into 64-bit words with a count before each word.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A packed bit vector with rank and select."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before position i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def place(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (from 0)."""
        w = np.searchsorted(self.before, k, "right") - 1
        x, left, at = self.words[w], k - self.before[w], w << 6
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= ones
            left, at, x = left - ones * up, at + width * up, np.where(up, x >> np.uint64(width), x)
        return at


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels = []
        for level in reversed(range(self.depth)):
            bit = (values >> level & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((level, BitRank(bit), zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i."""
        lo, hi = np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            one = (c >> level & 1).astype(bool)
            a, b = bits.ones(lo), bits.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_ranks(s: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array of s by its first ``depth`` symbols, by prefix doubling; ranks by the first depth-1 and depth."""
    rank = s.astype(np.int64)
    n = len(s)

    def merged(r: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
        behind = np.zeros(n, np.int64)
        behind[: n - h] = r[h:] + 1
        key = r * (int(r.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        step = np.zeros(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        new[order] = np.cumsum(step)
        return new, order

    span = 1
    while span * 2 < depth:
        rank, _ = merged(rank, span)
        span *= 2
    short, _ = merged(rank, depth - 1 - span) if depth - 1 > span else (rank, None)
    full, order = merged(rank, depth - span)
    # order sorts by depth symbols; ties keep text order.
    return order, {depth - 1: short, depth: full}


class FMIndex:
    """Index of a symbol sequence that ends in its smallest symbol, for matches of up to ``length`` symbols.

    Suffixes are sorted by their first ``length`` symbols; backward steps are exact up to matches of that length. What
    is kept is the wavelet matrix, two bit vectors that mark where suffixes begin to differ in their first length - 1 and
    length symbols, and, given ``weights`` by text position, one least weight for each distinct match of full length.
    """

    def __init__(self, s: np.ndarray, length: int, weights: np.ndarray | None = None):
        self.length, self.n = length, len(s)
        order, ranks = suffix_ranks(s, length)
        self.bwt = WaveletMatrix(s[order - 1].astype(np.int64), int(s.max()))
        counts = np.bincount(s, minlength=int(s.max()) + 1)
        self.below = np.cumsum(counts) - counts
        self.short, self.full = (BitRank(self._edges(ranks[k][order])) for k in (length - 1, length))
        if weights is not None:
            edge = np.flatnonzero(self._edges(ranks[length][order])[:-1])
            self.least = np.minimum.reduceat(weights[order], edge)

    @staticmethod
    def _edges(rank: np.ndarray) -> np.ndarray:
        """1 where a block of equal ranks begins, and behind the last."""
        out = np.ones(len(rank) + 1, np.uint8)
        out[1:-1] = rank[1:] != rank[:-1]
        return out

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of the suffixes that start with c and go on as those in [lo, hi)."""
        return self.below[c] + self.bwt.rank(c, lo), self.below[c] + self.bwt.rank(c, hi)

    def widened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that share their first length - 1 symbols with the lo-th."""
        block = self.short.ones(lo + 1)
        return self.short.place(block - 1), self.short.place(block)

    def least_weight(self, lo: np.ndarray) -> np.ndarray:
        """The least weight of the suffixes that share their first ``length`` symbols with the lo-th."""
        return self.least[self.full.ones(lo + 1) - 1]


def matching_windows(index: FMIndex, s: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Matching statistics of the streamed texts s[starts:ends), cut off at the index's length.

    Each text is read backwards, all texts abreast. After ``length`` steps its interval holds every place where the
    window occurs; before the next step the interval widens to the places that share the window's first length-1
    symbols, as the statistics of a longer text would. Yields (text, window start, interval start, interval end).
    """
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), index.n, np.int64)
    live = np.arange(len(starts))
    for step in range(1, int((ends - starts).max(initial=0)) + 1):
        live = live[ends[live] - step >= starts[live]]
        if len(live) == 0:
            return
        at = ends[live] - step
        a, b = (lo[live], hi[live]) if step <= index.length else index.widened(lo[live])
        a, b = index.extend(a, b, s[at])
        lo[live], hi[live] = a, b
        if step >= index.length:
            yield live, at, a, b
