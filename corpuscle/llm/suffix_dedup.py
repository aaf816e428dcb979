"""Operator 8: remove repeated strings of 100 bytes or more, by a logarithmic family of suffix arrays.

Texts are UTF-8 bytes. See ``repeats`` for the plan; a shard reads the passages of its anchors in document order, in
batches. Each batch gets a suffix array of its window starts and is merge-scanned against the levels that exist (one
ascending pass over two ascending arrays) for matches of 100 bytes; what is new becomes a level. Levels of about equal
size merge, so that there are logarithmically many. They hold positions in the passages' bytes, and what is compared is
the first 100 bytes of a suffix, all that the contract's matches need.

``SuffixFamily`` keeps such a family of levels for documents that come batch by batch: a new batch is held against all
that earlier runs left, then becomes a level.

Defined results: null and empty texts have no bytes; null doc_id sorts last; rows that repeat doc_id and text get
equal results; rows that share doc_id only are ordered by a hash of their text; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .anchors import byte_grams
from .pretoken import slices
from .repeats import FORMER, anchored, deduplicated, digest, keyed

WINDOW = 100
GRAM = 24
#: Bytes of passages in a batch.
BATCH = 1 << 20


class ByteUnits:
    length, k, finer = WINDOW, GRAM, (56, WINDOW)

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        self.b, self.offsets, self.n = np.ascontiguousarray(b), offsets, len(b)

    def grams(self, i: int, j: int, k: int) -> np.ndarray:
        return byte_grams(self.b[i : j + k - 1], k)

    def span(self, s: np.ndarray, e: np.ndarray):
        return s, e


class SuffixLevels:
    """Suffix arrays: bytes, window starts in ascending order of the ``length`` bytes there, and their texts' first places."""

    def __init__(self, length: int = WINDOW):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _heads(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ndarray((len(b) - self.length + 1,), f"V{self.length}", b, strides=(1,))[at].view(f"S{self.length}")

    def _merged(self, old: np.ndarray, new: np.ndarray):
        """(order, same) of two ascending arrays of distinct heads: their common order, and where in it a head of
        ``new`` stands behind an equal one of ``old``. The sort is a merge, since it goes by ascending runs."""
        both = np.concatenate([old, new])
        order = np.argsort(both, kind="stable")
        low, high = order[:-1], order[1:]
        meet = np.flatnonzero((low < len(old)) & (high >= len(old)))
        return order, meet[both[low[meet]] == both[high[meet]]] + 1

    def add(self, b: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """b: a batch's bytes; at: its window starts; key: their places, ascending and above those of earlier batches.
        Returns the least place of each window's text."""
        if len(at) == 0:
            return key
        heads = self._heads(b, at)
        order = np.argsort(heads, kind="stable")  # the first of equal ones is their earliest
        heads, place, key = heads[order], at[order], key[order]
        new = np.ones(len(heads), bool)
        new[1:] = heads[1:] != heads[:-1]
        lead, group = np.flatnonzero(new), np.cumsum(new) - 1
        heads, place, least = heads[lead], place[lead], key[lead]
        known = np.zeros(len(heads), bool)
        for old_b, old_at, old_key in self.levels:
            by, same = self._merged(self._heads(old_b, old_at), heads)
            mine = by[same] - len(old_at)
            least[mine], known[mine] = old_key[by[same - 1]], True
        self._push(b, place[~known], least[~known])
        out = np.empty(len(order), np.int64)
        out[order] = least[group]
        return out

    def _push(self, b: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        if not len(at):
            return
        while self.levels and len(self.levels[-1][1]) <= 2 * len(at):
            old_b, old_at, old_key = self.levels.pop()
            by, _ = self._merged(self._heads(old_b, old_at), self._heads(b, at))
            at, key = np.concatenate([old_at, at + len(old_b)])[by], np.concatenate([old_key, key])[by]
            b = np.concatenate([old_b, b])
        self.levels.append((b, at, key))


def least_places(units, b: np.ndarray, offsets: np.ndarray, first: np.ndarray):
    """``repeats.shards``: (least, at), where least[at[p] + j] is the least place of the text of passage p's j-th window."""
    count = np.diff(offsets) - units.length + 1
    at = np.cumsum(count) - count
    least = np.empty(count.sum(), np.int64)
    levels = SuffixLevels(units.length)
    order = np.argsort(first, kind="stable")
    upto = np.concatenate([[0], np.cumsum(np.diff(offsets)[order])])
    for i, j in slices(upto, BATCH):
        rows = order[i:j]
        size = np.diff(offsets)[rows]
        base = np.repeat(offsets[rows] - (upto[i:j] - upto[i]), size)
        part = b[base + np.arange(len(base))]
        n = count[rows]
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least[np.repeat(at[rows], n) + window] = levels.add(part, np.repeat(upto[i:j] - upto[i], n) + window, np.repeat(first[rows], n) + window)
    return least, at


def _report(view, gone):
    n = np.concatenate([[0], np.cumsum(gone)])[view.offsets]
    begins = np.zeros(view.n + 1, bool)
    begins[view.offsets] = True
    run = gone.copy()
    run[1:] &= ~gone[:-1] | begins[1 : view.n]
    spans = np.concatenate([[0], np.cumsum(run)])[view.offsets]
    kept = memoryview(np.ascontiguousarray(view.b[~gone]))
    edge = (view.offsets - n).tolist()
    hashes = [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(edge[:-1], edge[1:])]
    return [pa.array(np.diff(view.offsets)), pa.array(np.diff(n)), pa.array(np.diff(spans)), pa.array(hashes)]


def suffix_dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    return deduplicated(docs, ByteUnits, least_places, _report, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **how)


class SuffixFamily:
    """Documents that come batch by batch: each batch is held against all earlier ones, then becomes a level.

    A level is a folder under ``folder`` (one that all executors share) with two tables: the distinct texts (rk, d,
    text) and their anchors (a, rk, at). Only passages that a new batch shares get suffix arrays again. Levels of about
    equal size merge, so that n batches leave about log n levels; a merged level names the batches it holds, so that one
    left half done by a lost driver does no harm. The batches of one folder come one after the other.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def levels(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, texts) of the levels, in order."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(self.folder))]
        found = [tuple(map(int, x.split("-")[1:])) for x in names if x.startswith("level-")]
        whole = [x for x in found if self._files.exists(self._path(f"{self._at(x)}/anchors/_SUCCESS"))]
        return sorted(x for x in whole if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in whole))

    def _at(self, level) -> str:
        return f"{self.folder}/level-{level[0]}-{level[1]}-{level[2]}"

    def _read(self, kind: str, levels) -> DataFrame:
        return self.spark.read.parquet(*[f"{self._at(x)}/{kind}" for x in levels])

    def _write(self, level, texts: DataFrame, anchors) -> None:
        for kind, rows in (("texts", texts), ("anchors", anchors)):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self._at(level)}/{kind}")

    def add(self, docs: DataFrame) -> DataFrame:
        """The columns of suffix_dedup() for docs, all of which come after the documents of earlier calls."""
        levels, known = self.levels(), None
        docs = docs.select("doc_id", "text")
        if levels:
            former = F.lit(FORMER).alias("ord")
            known = self._read("texts", levels).select(former, "rk", "d", "text"), self._read("anchors", levels).select("a", former, "rk", "at")
        result = materialise(suffix_dedup(docs, known=known), "suffix-family")
        texts = keyed(docs).withColumn("d", digest("text")).dropDuplicates(["d"])
        if levels:
            texts = texts.join(self._read("texts", levels).select("d"), "d", "left_anti")
        texts = materialise(texts.select("ord", "rk", "d", "text"), "suffix-family-texts")
        batch = levels[-1][1] + 1 if levels else 0
        self._write((batch, batch, texts.count()), texts.drop("ord"), anchored(texts, ByteUnits).drop("ord"))
        discard(texts)
        self._merge()
        return result

    def _merge(self) -> None:
        while len(levels := self.levels()) > 1 and levels[-2][2] <= 2 * levels[-1][2]:
            two = levels[-2:]
            self._write((two[0][0], two[1][1], two[0][2] + two[1][2]), self._read("texts", two), self._read("anchors", two))
            for x in two:
                self._files.delete(self._path(self._at(x)), True)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(doc_id, 9223372036854775807) AS ord,
                  encode(coalesce(text, '')) AS bs FROM documents),
w AS (SELECT rn, ord, i, md5_number(bs[i:i + 99]) AS g
      FROM (SELECT rn, ord, bs, unnest(generate_series(1, octet_length(bs) - 99)) AS i FROM d WHERE octet_length(bs) >= 100)),
f AS (SELECT g, min((ord, i)) AS first FROM w GROUP BY g HAVING count(*) > 1),
x AS (SELECT w.rn, w.i FROM w JOIN f ON w.g = f.g WHERE (w.ord, w.i) > f.first),
h AS (SELECT rn, regexp_extract_all(hex(bs), '..') AS hs FROM d),
b AS (SELECT rn, unnest(hs) AS byte, generate_subscripts(hs, 1) AS i FROM h),
m AS (SELECT b.rn, b.i, b.byte, coalesce(max(x.i) OVER (PARTITION BY b.rn ORDER BY b.i) > b.i - 100, false) AS gone
      FROM b LEFT JOIN x ON x.rn = b.rn AND x.i = b.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rn ORDER BY i), false) AS begins FROM m),
o AS (SELECT rn, count(*) AS n, count(*) FILTER (gone) AS k, count(*) FILTER (begins) AS s, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
      FROM r GROUP BY rn)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(k, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o ON o.rn = d.rn
"""
