"""Queries that align sentences and recordings, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sequences
from .catalogue import _D_PAIRS, _D_PARA, _docs, _pairs
from .registry import query


def _sides(spark, sf):
    """Question and answer of a conversation as two sides, in sentences."""
    return _pairs(spark, sf).select("conv_id", "turn", X.sentences(F.col("a")).alias("a"), X.sentences(F.col("b")).alias("b"))


@query()
def sentence_beads(spark, sf):
    rows = sequences.sentence_beads(_sides(spark, sf), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "bead", "kind", F.md5(F.array_join("a", "\n")).alias("a"), F.md5(F.array_join("b", "\n")).alias("b"), "cost")


# The table of least costs, row by row: before and last are the rows of the two sentences before, from 0 sentences of b on.
_D_SPLIT = lambda c: f"""list_filter(string_split(regexp_replace(regexp_replace(coalesce({c}, ''), '([.!?]+["''”’)]*)\\s+', '\\1' || chr(1), 'g'), '([。！？]+[”’」』）]*)\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^\\s\\x{{3000}}\\x{{00A0}}]'))"""
_COST = lambda x, y: f"(1000 * (({x}) - ({y})) * (({x}) - ({y})) // (68 * greatest(({x}) + ({y}), 1)))"


@query(f"""WITH RECURSIVE {_D_PAIRS}, l AS (SELECT conv_id, turn, list_transform({_D_SPLIT('a')}, lambda s: length(s)) AS a, list_transform({_D_SPLIT('b')}, lambda s: length(s)) AS b FROM p),
k AS (SELECT *, list_transform(range(0, len(b) + 1), lambda j: coalesce(list_sum(list_transform(b[1:j], lambda y: {_COST('0', 'y')} + 531)), 0)::BIGINT) AS c FROM l),
r AS (SELECT conv_id, turn, a, b, c, 0 AS i, list_transform(c, lambda x: 1000000000000000::BIGINT) AS before, c AS last FROM k
UNION ALL SELECT conv_id, turn, a, b, c, i + 1, last, list_transform(range(1, len(b) + 2), lambda j: c[j] + list_min(list_transform(base[1:j], lambda x, q: x - c[q]))) FROM (
SELECT *, list_transform(range(1, len(b) + 2), lambda j: list_min([last[j] + {_COST('a[i + 1]', '0')} + 531,
CASE WHEN j > 1 THEN last[j - 1] + {_COST('a[i + 1]', 'b[j - 1]')} + 12 END, CASE WHEN j > 2 THEN last[j - 2] + {_COST('a[i + 1]', 'b[j - 2] + b[j - 1]')} + 311 END,
CASE WHEN j > 1 AND i > 0 THEN before[j - 1] + {_COST('a[i] + a[i + 1]', 'b[j - 1]')} + 311 END, CASE WHEN j > 2 AND i > 0 THEN before[j - 2] + {_COST('a[i] + a[i + 1]', 'b[j - 2] + b[j - 1]')} + 451 END])::BIGINT) AS base
FROM r WHERE i < len(a)))
SELECT conv_id, turn, len(a)::BIGINT AS n_a, len(b)::BIGINT AS n_b, last[len(b) + 1]::BIGINT AS cost FROM r WHERE i = len(a) AND len(a) + len(b) > 0""")
def sentence_alignment(spark, sf):
    """Sentences of both sides in beads, and what the best pairing costs."""
    n = lambda c: F.sum(F.size(c)).cast("long")
    rows = sequences.sentence_beads(_sides(spark, sf), ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn").agg(n("a").alias("n_a"), n("b").alias("n_b"), F.sum("cost").alias("cost"))


def _recordings(spark, sf):
    """Paragraphs as texts; as segments the same in small letters, without those whose digest begins with 0, those that begin
    with 1 four places late."""
    paras = X.paragraphs(F.col("text"))
    # The digit goes along: inside of a lambda the paragraphs would be split again for each of them.
    told = F.transform(paras, lambda x, i: F.struct(F.substring(F.md5(x), 1, 1).alias("digit"), i.alias("i"), F.lower(x).alias("x")))
    late = lambda x: F.struct((x["i"] + F.when(x["digit"] == "1", 4.5).otherwise(0.0)).alias("at"), x["i"].alias("i"), x["x"].alias("x"))
    told = F.transform(F.array_sort(F.transform(F.filter(told, lambda x: x["digit"] != "0"), late)), lambda x: x["x"])
    return _docs(spark, sf).select("doc_id", "lang", F.transform(paras, F.lower).alias("texts"), told.alias("segments"))


@query()
def speech_alignment(spark, sf):
    return sequences.speech_alignment(_recordings(spark, sf), ["doc_id", "lang"], "texts", "segments")


@query(f"""WITH {_D_PARA}, n AS (SELECT rn, count(*) AS n, count(*) FILTER (md5(para)[1] != '0') AS k FROM p GROUP BY rn),
d AS (SELECT row_number() OVER () AS rn, lang FROM documents)
SELECT lang, sum(n)::BIGINT AS n, sum(k)::BIGINT AS segments FROM d JOIN n ON n.rn = d.rn GROUP BY lang""")
def speech_segments(spark, sf):
    """Texts and segments of all recordings by language; every segment is some text's."""
    rows = sequences.speech_alignment(_recordings(spark, sf), ["doc_id", "lang"], "texts", "segments", least=0.0)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("segment").alias("segments"))
