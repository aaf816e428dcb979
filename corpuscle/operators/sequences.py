"""Alignment of two sequences: sentences of a paragraph pair by length, texts and recordings by similarity.

Each pair of sequences is one row with two arrays, so nothing is shuffled here; rows go to Python in Arrow batches. For
sentences only their lengths do, and Spark cuts the texts by the places that come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Sentences -------------------------------------------------------------------------------------------------------

#: Fixed values of the published length model: 100 * -ln of how often a bead of (sentences of a, of b) occurs, in the order
#: in which ties are decided; and the variance of a character's translation, times ten.
BEADS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2))
PRIORS = (12, 531, 531, 311, 311, 451)
VARIANCE = 68
#: Half the width of the first band of diagonals.
BAND = 16
_FAR = np.int64(1) << 60


def length_cost(x, y):
    """100 * the squared, normed difference of two lengths, halved; a whole number, rounded down."""
    total = np.maximum(x + y, 1)
    return 1000 * (x - y) * (x - y) // (VARIANCE * total)


def beads(la, lb, band: int = BAND) -> list[tuple[int, int, int, int, int]]:
    """(a_from, a_to, b_from, b_to, cost) of the least dear pairing of two lists of lengths, in order.

    A band of diagonals is tried first. A path that leaves it changes diagonal so often, at a prior of 311 or more each
    time, that the best path inside is proven best if it costs less; else the band is doubled.
    """
    la, lb = np.asarray(la, np.int64), np.asarray(lb, np.int64)
    n, m = len(la), len(lb)
    while True:
        found = _banded(la, lb, band)
        if band >= n + m or sum(x[4] for x in found) < min(PRIORS[3:5]) * (abs(m - n) + 2 * (band + 1)):
            return found
        band *= 2


def _banded(la: np.ndarray, lb: np.ndarray, band: int):
    n, m = len(la), len(lb)
    low, high = min(0, m - n) - band, max(0, m - n) + band
    width = high - low + 1
    two_a, two_b = np.append(0, la[1:] + la[:-1]) if n else la, np.append(0, lb[1:] + lb[:-1]) if m else lb
    pad = lambda x: np.concatenate([[0], x])  # noqa: E731  by end
    one_b, two_b = pad(lb), pad(two_b)
    skip_b = pad(np.cumsum(length_cost(0, lb) + PRIORS[2]))
    far = np.full(width + 2, _FAR)
    before, last = far.copy(), far.copy()  # rows i - 2 and i - 1, with one cell on either side
    choice = np.zeros((n + 1, width), np.uint8)
    t = np.arange(width)
    for i in range(n + 1):
        j = i + low + t
        inside = (j >= 0) & (j <= m)
        at = np.clip(j, 0, m)
        options = np.full((6, width), _FAR)
        if i == 0:
            options[0, j == 0] = 0
        if i >= 1:
            a = la[i - 1]
            options[0] = np.where(j >= 1, last[1:-1] + length_cost(a, one_b[at]) + PRIORS[0], _FAR)
            options[1] = last[2:] + length_cost(a, 0) + PRIORS[1]
            options[4] = np.where(j >= 2, last[:-2] + length_cost(a, two_b[at]) + PRIORS[4], _FAR)
        if i >= 2:
            a = two_a[i - 1]
            options[3] = np.where(j >= 1, before[2:] + length_cost(a, one_b[at]) + PRIORS[3], _FAR)
            options[5] = np.where(j >= 2, before[1:-1] + length_cost(a, two_b[at]) + PRIORS[5], _FAR)
        options[:, ~inside] = _FAR
        best = options.argmin(0)
        # A run of (0, 1) beads costs the difference of two sums, so that its start is a running minimum.
        free = options[best, t] - skip_b[at]
        least = np.minimum.accumulate(np.where(inside, free, _FAR))
        choice[i] = np.where(least < free, 2, best)
        row = far.copy()
        row[1:-1] = np.where(inside, np.minimum(least + skip_b[at], _FAR), _FAR)
        before, last = last, row
    out, i, j = [], n, m
    while i or j:
        da, db = BEADS[choice[i, j - i - low]]
        cost = int(length_cost(la[i - da : i].sum(), lb[j - db : j].sum())) + PRIORS[BEADS.index((da, db))]
        out.append((i - da, i, j - db, j, cost))
        i, j = i - da, j - db
    return out[::-1]


_BEADS = "array<struct<a_from int, a_to int, b_from int, b_to int, cost long>>"
_BEAD_TYPE = pa.list_(pa.struct([("a_from", pa.int32()), ("a_to", pa.int32()), ("b_from", pa.int32()), ("b_to", pa.int32()), ("cost", pa.int64())]))


def _added(df: DataFrame, keep: list[Column], inputs: list[Column], run, name: str, ddl: str) -> DataFrame:
    """The columns ``keep`` and one that run(lists of the inputs' values) gives."""
    ship(df.sparkSession)
    kept = df.select(*keep)
    names, n = kept.columns, len(inputs)
    sent = df.select(*keep, *[c.alias(f"__in{k}") for k, c in enumerate(inputs)])

    def batches_(batches):
        for batch in batches:
            values = [batch.column(len(names) + k).to_pylist() for k in range(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], run(*values)], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return sent.mapInArrow(batches_, f"{fields}, `{name}` {ddl}")


def sentence_beads(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b", band: int = BAND) -> DataFrame:
    """Paragraph pairs (key, arrays a and b of sentences) to beads: key, bead (from 0), kind ('2-1'), a and b (arrays of the
    bead's sentences), cost.

    Every sentence is in one bead, in order. Null arrays are empty; a null sentence has length 0; where one side is empty all
    sentences of the other stand alone; two empty sides have no bead. Of pairings that cost the same, the one whose last
    differing bead comes first in BEADS.
    """
    sizes = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.coalesce(F.length(s), F.lit(0)))
    whole = lambda c, name: F.coalesce(c, F.array().cast("array<string>")).alias(name)
    run = lambda xs, ys: pa.array([[dict(zip(("a_from", "a_to", "b_from", "b_to", "cost"), x)) for x in beads(la, lb, band)] for la, lb in zip(xs, ys)], _BEAD_TYPE)
    found = _added(pairs, [*map(F.col, key), whole(a, "__a"), whole(b, "__b")], [sizes(F.col(a)), sizes(F.col(b))], run, "__beads", _BEADS)
    rows = found.select(*key, "__a", "__b", F.posexplode("__beads").alias("bead", "x"))
    cut = lambda c, side: F.slice(c, F.col(f"x.{side}_from") + 1, F.col(f"x.{side}_to") - F.col(f"x.{side}_from"))
    kind = F.concat_ws("-", (F.col("x.a_to") - F.col("x.a_from")).cast("string"), (F.col("x.b_to") - F.col("x.b_from")).cast("string"))
    return rows.select(*key, "bead", kind.alias("kind"), cut("__a", "a").alias("a"), cut("__b", "b").alias("b"), F.col("x.cost").alias("cost"))


# Texts and recordings --------------------------------------------------------------------------------------------

#: The least cosine of two segments that may be one.
LEAST = 0.5
_UNIT = 1_000_000
#: Up to so many pairs of texts, and of places that share a trigram, all similarities of a recording are found at once and
#: kept; of longer ones a row is made when it is needed.
_KEPT = 1 << 20


def _trigrams(text: str) -> np.ndarray:
    """Every three characters in a row as one number; shorter texts are one gram, filled up."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    if 0 < len(c) < 3:
        c = np.concatenate([c, np.full(3 - len(c), 0x1FFFFF)])  # no code point
    return c[:-2] | c[1:-1] << 21 | c[2:] << 42


def _millionths(dots: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return np.floor(np.divide(dots, norm, out=np.zeros_like(norm), where=norm > 0) * _UNIT + 0.5).astype(np.int64)


def _similarities(texts: list[str]) -> np.ndarray | None:
    """Of every two texts; None if too many of their places share a trigram."""
    grams = [_trigrams(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    _, gram = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]), return_inverse=True)
    held, times = np.unique(gram * len(texts) + of, return_counts=True)
    gram, of = np.divmod(held, len(texts))
    # Every row of (gram, text, times) meets those of its gram.
    n = np.bincount(gram)
    if (n * n).sum() > _KEPT:
        return None
    upto = np.cumsum(n[gram])
    first = (np.cumsum(n) - n)[gram]
    one = np.repeat(np.arange(len(held)), n[gram])
    other = np.arange(len(one)) + np.repeat(first - (upto - n[gram]), n[gram])
    dots = np.bincount(of[one] * len(texts) + of[other], times[one] * times[other], len(texts) ** 2).reshape(len(texts), -1)
    norms = dots.diagonal()
    return _millionths(dots, np.sqrt(norms[:, None] * norms))


class Similarity:
    """Cosines of the character trigrams of two lists of texts, in millionths, row by row."""

    def __init__(self, a: list[str], b: list[str]):
        place = {t: k for k, t in enumerate(dict.fromkeys((*a, *b)))}
        self.all = _similarities(list(place)) if len(place) ** 2 <= _KEPT else None
        if self.all is not None:
            self.all = self.all[np.ix_(np.array([place[t] for t in a], np.int64), np.array([place[t] for t in b], np.int64))]
            return
        known = [np.unique(_trigrams(t), return_counts=True) for t in place]
        self.a, held = [known[place[t]] for t in a], [known[place[t]] for t in b]
        self.norms = np.array([(k * k).sum() for _, k in held], np.float64)
        none = np.zeros(0, np.int64)
        grams, times = (np.concatenate([none, *(h[x] for h in held)]) for x in (0, 1))
        texts = np.repeat(np.arange(len(b)), [len(g) for g, _ in held])
        order = np.argsort(grams, kind="stable")
        #: Of each distinct gram, the texts that hold it, from starts[k] to starts[k + 1].
        self.known, first = np.unique(grams[order], return_index=True)
        self.texts, self.times, self.starts = texts[order], times[order], np.append(first, len(order))

    def row(self, i: int) -> np.ndarray:
        if self.all is not None:
            return self.all[i]
        grams, times = self.a[i]
        k = np.searchsorted(self.known, grams)
        there = k < len(self.known)
        there[there] = self.known[k[there]] == grams[there]
        k, own = k[there], times[there]
        n = self.starts[k + 1] - self.starts[k]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(n) else 0) + np.repeat(self.starts[k] - (upto - n), n)
        dots = np.bincount(self.texts[at], np.repeat(own, n) * self.times[at], len(self.norms))
        norm = np.sqrt((times * times).sum() * self.norms)
        return _millionths(dots, norm)


def monotone(rows, n: int, m: int, least: int) -> list[tuple[int, int]]:
    """Pairs (i, j), both ascending, of greatest summed similarity; only pairs of ``least`` or more count. rows(i): similarities
    of i. Ties: a pair before a gap, a gap in a before one in b, from the end."""
    last = np.zeros(m + 1, np.int64)
    choice = np.zeros((n + 1, m + 1), np.uint8)
    choice[0, 1:] = 2
    for i in range(1, n + 1):
        sims = rows(i - 1)
        pair = np.where(sims >= least, last[:-1] + sims, -1)
        own = last.copy()
        own[1:] = np.maximum(own[1:], pair)
        best = np.maximum.accumulate(own)
        choice[i] = np.where(best > own, 2, 1)
        choice[i, 1:][pair == best[1:]] = 0
        last = best
    out, i, j = [], n, m
    while i and j:
        if choice[i, j] == 0:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif choice[i, j] == 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_segments(a: list[str], b: list[str], least: float = LEAST) -> list[tuple[int, int, int, str]]:
    """(i, j, similarity in millionths, method) for the texts of a that have a segment of b, by i.

    ordinal: both lists are as long and every text is like the segment of its place, and none more like another; sequence: by monotone alignment; moved: of those
    left over, pairs out of order, the most alike first (ties: least i, then least j).
    """
    low = round(least * _UNIT)
    if a == b and all(a) and low <= _UNIT:
        return [(i, i, _UNIT, "ordinal") for i in range(len(a))]
    sims = Similarity(a, b)
    if len(a) == len(b):
        same = []
        for i in range(len(a)):
            row = sims.row(i)
            if row[i] < low or row[i] < row.max():
                break
            same.append((i, i, int(row[i]), "ordinal"))
        else:
            return same
    pairs = monotone(sims.row, len(a), len(b), low) if len(b) else []
    out = [(i, j, int(sims.row(i)[j]), "sequence") for i, j in pairs]
    used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
    free = np.array([j for j in range(len(b)) if j not in used_b], np.int64)
    rest = []
    for i in (i for i in range(len(a)) if i not in used_a):
        row = sims.row(i)[free]
        rest += [(-int(row[k]), i, int(free[k])) for k in np.flatnonzero(row >= low)]
    for s, i, j in sorted(rest):
        if i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j)
            out.append((i, j, -s, "moved"))
    return sorted(out)


_FOUND = "array<struct<segment int, similarity double, method string>>"
_FOUND_TYPE = pa.list_(pa.struct([("segment", pa.int32()), ("similarity", pa.float64()), ("method", pa.string())]))


def _places(texts, segments, least: float) -> list[dict | None]:
    found = {i: {"segment": j, "similarity": s / _UNIT, "method": how} for i, j, s, how in align_segments([t or "" for t in texts], [t or "" for t in segments], least)}
    return [found.get(i, {}) for i in range(len(texts))]


def speech_alignment(recordings: DataFrame, key: list[str], texts: str, segments: str, least: float = LEAST) -> DataFrame:
    """Recordings (key, array of texts, array of transcribed segments) to one row per text: key, ordinal, segment (its place
    in segments, or null), similarity (0 to 1, or null), method.

    Missing and misordered segments are bridged by similarity. A segment serves one text at most. Null arrays are empty, null
    and empty texts and segments are like nothing; a recording without texts has no row; rows that repeat a key are
    recordings of their own.
    """
    none = F.array().cast("array<string>")
    run = lambda ts, ss: pa.array([_places(t, s, least) for t, s in zip(ts, ss)], _FOUND_TYPE)
    found = _added(recordings, list(map(F.col, key)), [F.coalesce(texts, none), F.coalesce(segments, none)], run, "__found", _FOUND)
    return found.select(*key, F.posexplode("__found").alias("ordinal", "x")).select(*key, "ordinal", "x.*")
