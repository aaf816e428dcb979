"""Operator 1: remove repeated passages of 20 words or more, by FM-indexes.

Texts are sequences of words. See ``repeats`` for the plan; each shard holds the distinct passages of its anchors, whose
words are numbered and joined into one sequence with a compressed FM-index (``fm_index``). The documents' passages
stream through it backwards; the matching statistics give for each window of 20 words the interval of all places where
it occurs, and it survives only at the first of them.

Defined results: null and empty texts have no words; null doc_id sorts last; rows that repeat doc_id and text get
equal results; rows that share doc_id only are ordered by a hash of their text; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Words, unit_grams, word_hashes
from .fm_index import FMIndex, matching_windows
from .repeats import deduplicated

WINDOW = 20
GRAM = 5


class WordUnits:
    length, k, finer = WINDOW, GRAM, (12, WINDOW)

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        w = Words(b, offsets)
        self.b, self.starts, self.ends, self.offsets, self.n = w.b, w.starts, w.ends, w.offsets, w.n
        self._hashes = None

    def grams(self, i: int, j: int, k: int) -> np.ndarray:
        if self._hashes is None:
            self._hashes = word_hashes(self.b, self.starts, self.ends)
        return unit_grams(self._hashes[i : j + k - 1], k)

    def span(self, s: np.ndarray, e: np.ndarray):
        """Byte range of words s..e-1."""
        return self.starts[s], self.ends[e - 1]


def least_places(units, b: np.ndarray, offsets: np.ndarray, first: np.ndarray):
    """``repeats.shards``: (least, at), where least[at[p] + j] is the least place of the text of passage p's j-th window."""
    words = Words(b, offsets)
    ends = words.ends.astype(np.int32)
    # Words as one binary array; the blank after each belongs to none.
    cuts = np.empty(2 * words.n + 1, np.int32)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = words.starts, ends, len(words.b)
    tokens = pa.Array.from_buffers(pa.binary(), 2 * words.n, [None, pa.py_buffer(cuts), pa.py_buffer(words.b)]).take(pa.array(np.arange(0, 2 * words.n, 2)))
    ids = tokens.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    n = len(offsets) - 1
    # A separator, smaller than all words, stands after each passage.
    text = np.repeat(np.arange(n), np.diff(words.offsets))
    s = np.zeros(words.n + n, np.int64)
    place = np.arange(words.n) + text
    s[place] = ids
    begin, end = words.offsets[:-1] + np.arange(n), words.offsets[1:] + np.arange(n)
    weight = np.full(len(s), np.iinfo(np.int64).max)
    weight[place] = first[text] + (place - begin[text])
    index = FMIndex(s, units.length, weight)
    count = np.diff(words.offsets) - units.length + 1
    at = np.cumsum(count) - count
    least = np.empty(count.sum(), np.int64)
    for which, where, lo, _ in matching_windows(index, s, begin, end):
        least[at[which] + where - begin[which]] = index.least_weight(lo)
    return least, at


def _report(view, gone):
    keep = np.repeat(~gone, np.diff(np.append(view.starts, len(view.b))))
    kept = view.b[keep]
    upto = np.concatenate([[0], np.cumsum(keep)])
    edge = upto[np.append(view.starts, len(view.b))[view.offsets]]
    n = np.concatenate([[0], np.cumsum(gone)])[view.offsets]
    raw = memoryview(np.ascontiguousarray(kept))
    # Every word but a text's last is followed by its blank.
    hashes = [hashlib.sha256(raw[s : max(e - 1, s)]).hexdigest() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return [pa.array(np.diff(view.offsets)), pa.array(np.diff(n)), pa.array(hashes)]


def substring_dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    return deduplicated(docs, WordUnits, least_places, _report, "n_words long, n_removed long, kept_sha256 string", **how)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(doc_id, 9223372036854775807) AS ord,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rn, ord, i, md5_number(array_to_string(list_slice(ws, i, i + 19), ' ')) AS g
      FROM (SELECT rn, ord, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT g, min((ord, i)) AS first FROM w GROUP BY g HAVING count(*) > 1),
x AS (SELECT w.rn, w.i FROM w JOIN f ON w.g = f.g WHERE (w.ord, w.i) > f.first),
b AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
m AS (SELECT b.rn, b.i, b.word, coalesce(max(x.i) OVER (PARTITION BY b.rn ORDER BY b.i) > b.i - 20, false) AS gone
      FROM b LEFT JOIN x ON x.rn = b.rn AND x.i = b.i),
o AS (SELECT rn, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY rn)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.rn = d.rn
"""
