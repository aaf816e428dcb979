"""Vectorised pre-tokenisation of UTF-8 buffers by the byte-level BPE split pattern.

Works on whole Arrow batches of texts at once, in numpy, and reproduces the matches of the pattern
(contractions, runs of letters, numbers or other marks with one leading blank, white space). Code points whose
category has changed between Unicode versions are not trusted here: a text that holds one is reported, and the
caller encodes it with the library itself.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE, UNSURE, INNER = 0, 1, 2, 3, 4, 5
_WHITE = {0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14), 0x20, *range(0x2000, 0x200B)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point below 0x30000; later ones are unsure."""
    out = np.full(0x110000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    new = unicodedata.category
    for cp in range(0x30000):
        c = chr(cp)
        kind = new(c)
        if kind != old(c) or kind in ("Cn", "Cs"):
            continue
        out[cp] = SPACE if cp in _WHITE else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return out


@lru_cache(maxsize=1)
def _ascii() -> np.ndarray:
    out = np.full(256, INNER, np.uint8)
    out[:128] = _classes()[:128]
    out[0xF8:] = UNSURE
    return out


def byte_classes(b: np.ndarray) -> np.ndarray:
    """Class of the code point that each byte belongs to."""
    cls = _ascii()[b]
    wide = np.flatnonzero(b >= 0xC0)
    if len(wide) == 0:
        return cls
    padded = np.concatenate([b, np.zeros(4, np.uint8)]).astype(np.int32)
    lead = padded[wide]
    size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    cp = lead & np.where(size == 4, 7, np.where(size == 3, 15, 31))
    for k in (1, 2, 3):
        more = size > k
        cp = np.where(more, (cp << 6) | (padded[wide + k] & 63), cp)
    kind = _classes()[np.minimum(cp, 0x10FFFF)]
    cls[wide] = kind
    for k in (1, 2, 3):
        more = size > k
        at = wide[more] + k
        inside = at < len(b)
        cls[at[inside]] = kind[more][inside]
    return cls


def boundaries(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, unsure): byte positions at which pre-tokens start, ascending, for the texts b[offsets[i]:offsets[i+1]];
    and for each text whether it holds code points that are not trusted here."""
    n = len(b)
    unsure = np.zeros(len(offsets) - 1, bool)
    if n == 0:
        return np.zeros(0, np.int64), unsure
    cls = byte_classes(b)
    odd = np.flatnonzero(cls >= UNSURE)
    if len(odd):
        unsure[np.searchsorted(offsets, odd, "right") - 1] = True
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:n]
    flag = np.empty(n, bool)
    flag[0] = True
    np.not_equal(cls[1:], cls[:-1], out=flag[1:])
    flag |= begins
    # The last white-space character before a run: a blank joins the run, any other stands alone.
    run = np.flatnonzero(flag[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~begins[1:]) + 1
    blank = b[run - 1] == 0x20
    flag[run[blank]] = False
    flag[run[blank] - 1] = True
    last = run[~blank] - 1
    if len(last):
        for _ in range(3):
            back = (b[last] & 0xC0) == 0x80
            if not back.any():
                break
            last = last - back
        flag[last] = True
    # Contractions, only where the apostrophe itself starts a pre-token.
    quote = np.flatnonzero((b == 0x27) & flag)
    quote = quote[quote + 1 < n]
    quote = quote[~begins[quote + 1]]
    if len(quote):
        x = b[quote + 1]
        y = np.where((quote + 2 < n) & ~begins[np.minimum(quote + 2, n - 1)], b[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        flag[quote[one | two] + 1] = False
        end = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
        flag[end[end < n]] = True
    return np.flatnonzero(flag), unsure


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets from 0) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """(i, j) ranges of texts of about ``most`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _holds(b: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Which of the texts hold ``mark``."""
    raw, out, at = np.ascontiguousarray(b).tobytes(), np.zeros(len(offsets) - 1, bool), 0
    while (at := raw.find(mark, at)) >= 0:
        text = int(np.searchsorted(offsets, at, "right")) - 1
        if at + len(mark) <= offsets[text + 1]:
            out[text] = True
            at = int(offsets[text + 1])
        else:
            at += 1
    return out


class PieceEncoder:
    """Encodes batches of texts: each distinct pre-token once per batch, with a bounded memory of frequent ones.

    Texts that hold one of ``marks`` (tokens that the library looks for before it splits) go to ``encode_text`` whole.
    """

    def __init__(self, encode_pieces, encode_text, remember: int = 100_000, marks: tuple[bytes, ...] = ()):
        self.encode_pieces, self.encode_text, self.remember, self.marks = encode_pieces, encode_text, remember, marks
        self.known: dict[bytes, list[int]] = {}

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        known = self.known
        out = [known.get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            for i, ids in zip(new, self.encode_pieces([pieces[i] for i in new])):
                out[i] = ids
                if len(known) < self.remember:
                    known[pieces[i]] = ids
        return out

    def __call__(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, int64 offsets of each text's ids)."""
        n = len(offsets) - 1
        starts, unsure = boundaries(b, offsets)
        for mark in self.marks:
            unsure |= _holds(b, offsets, mark)
        if len(starts):
            ends = np.append(starts, len(b)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b))])
            coded = pieces.dictionary_encode()
            got = self._pieces(coded.dictionary.to_pylist())
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))
            first = np.cumsum(sizes) - sizes
            code = coded.indices.to_numpy()
            count = sizes[code]
            upto = np.cumsum(count)
            ids = flat[np.repeat(first[code] - (upto - count), count) + np.arange(upto[-1])]
            at = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        else:
            ids, at = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if not unsure.any():
            return ids, at
        parts = []
        for i in range(n):
            if unsure[i]:
                parts.append(np.asarray(self.encode_text(b[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), np.uint32))
            else:
                parts.append(ids[at[i] : at[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
