"""Anchors: positions chosen by content alone, so that equal windows of units choose the same one.

A unit is a byte or a word. Each window of ``length`` units chooses, among the runs of ``k`` units inside it, the
one with the smallest hash (leftmost of equals). Equal windows make equal choices at equal offsets, so two
documents share a window only if they share an anchor, and only anchors that occur more than once need a closer
look: about 2 / (length - k + 2) of all positions are anchors. Everything here is vectorised over the texts of an
Arrow batch.
"""

from __future__ import annotations

import numpy as np

M = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    np.uint64,
)
_BASE = 0x100000001B3
_POS = 23
BLOCK = 1 << 20
STEP = 1 << 17
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over the upper half (in place)."""
    x ^= x >> np.uint64(32)
    x *= M[4]
    x ^= x >> np.uint64(29)
    x *= M[5]
    return x


def byte_grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of b[i:i+k] for every i (k of 8 or more)."""
    n = len(b) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = np.ascontiguousarray(b)
    eight = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    h = eight[:n] * M[0]
    for j in range(1, k // 8):
        h ^= h >> np.uint64(31)
        h += eight[8 * j : 8 * j + n]
        h *= M[j % 4]
    if k % 8:
        h ^= h >> np.uint64(31)
        h += eight[k - 8 : k - 8 + n]
        h *= M[4]
    return mix(h)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, n of each at least."""
    if _powers and len(_powers[0][0]) >= n:
        return _powers[0]
    size = max(STEP, 1 << (n - 1).bit_length())
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    tables = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == STEP:
        _powers.append(tables)
    return tables


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each b[starts[i]:ends[i]] by prefix sums of powers, some STEP bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        part = b[lo : int(ends[j - 1])]
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * M[6]
        i = j
    return mix(out)


def unit_grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of units i..i+k-1 from the units' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= M[0]
        out += h[j : j + n]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span, m = 1, x.copy()
    while span * 2 <= w:
        np.minimum(m[: len(m) - span], m[span:], out=m[: len(m) - span])
        m = m[: len(m) - span]
        span *= 2
    return np.minimum(m[:n], m[w - span : w - span + n])


def anchor_runs(grams, n_units: int, offsets: np.ndarray, length: int, k: int):
    """(anchor, start, count) of every run of windows with the same anchor, in order.

    grams(i, j): hashes of the k-unit runs that start at units i..j-1 (fewer at the end). offsets: the texts' unit
    boundaries. start: unit at which the first window of the run begins; count: number of windows. Works block by
    block, so memory doesn't grow with a text's length; a run over a block's edge comes as two.
    """
    w = length - k + 1
    sizes = np.diff(offsets)
    long = sizes >= length
    first, stop = offsets[:-1][long], offsets[1:][long] - length + 1
    found = []
    for at in range(0, max(n_units - length + 1, 0), BLOCK):
        n = min(BLOCK, n_units - length + 1 - at)
        lo, hi = np.searchsorted(stop, at, "right"), np.searchsorted(first, at + n, "left")
        if hi <= lo:
            continue
        g = grams(at, at + n + w - 1)
        tagged = (g & ~np.uint64((1 << _POS) - 1)) | np.arange(len(g), dtype=np.uint64)
        m = window_min(tagged, w)[:n]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        s, e = np.maximum(first[lo:hi] - at, 0), np.minimum(stop[lo:hi] - at, n)
        new[s] = True
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, s, 1)
        np.add.at(inside, e, -1)
        inside = np.cumsum(inside[:n], dtype=np.int8).view(bool)
        start = np.flatnonzero(new & inside)
        if len(start) == 0:
            continue
        end = np.append(start[1:], n)
        text_end = e[np.searchsorted(s, start, "right") - 1]
        count = np.minimum(end, text_end) - start
        anchor = g[(m[start] & np.uint64((1 << _POS) - 1)).astype(np.int64)]
        found.append((anchor, start + at, count))
    if not found:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*found))


class Words:
    """The words of an Arrow batch's texts, each text's joined by single blanks: ``b``; ``starts`` and ``ends`` of
    the words in b; ``offsets``: the texts' boundaries in words."""

    _BLANK = np.zeros(256, bool)
    _BLANK[[0x20, *range(9, 14)]] = True

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        blank = self._BLANK[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[offsets] = True
        edge = edge[: len(b)]
        before = np.ones(len(b), bool)
        before[1:] = blank[:-1]
        start = ~blank & (before | edge)
        at = np.flatnonzero(start)
        # One blank before each word but a text's first: words are copied behind it.
        run = np.cumsum(start)
        keep = ~blank
        place = np.cumsum(keep) - 1
        self.starts = place[at] + np.arange(len(at))
        out = np.full(int(keep.sum()) + len(at), 0x20, np.uint8)
        out[(place + run - 1)[keep]] = b[keep]
        self.b = out
        self.ends = np.append(self.starts[1:], len(out) + 0) - 1 if len(at) else self.starts
        self.offsets = np.searchsorted(at, offsets)
        self.n = len(at)
