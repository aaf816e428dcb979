"""Boards to paragraphs to sentences and back. Ordinals are columns; arrays are rebuilt by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with p (0-based) and paragraph; a narrow step."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(X.paragraphs(F.col(text))).alias("p", "paragraph"))


def sentences(paras: DataFrame) -> DataFrame:
    keep = [c for c in paras.columns if c != "paragraph"]
    return paras.select(*keep, F.posexplode(X.sentences(F.col("paragraph"))).alias("s", "sentence"))


def nest(rows: DataFrame, key: str) -> DataFrame:
    """Sentence rows (key, p, s, sentence) to one row per key: paragraphs array<struct<p, sentences array<struct<s, sentence>>>>."""
    by_p = rows.groupBy(key, "p").agg(F.array_sort(F.collect_list(F.struct("s", "sentence"))).alias("sentences"))
    return by_p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "sentences"))).alias("paragraphs"))


def flatten(nested: DataFrame, key: str) -> DataFrame:
    """What nest() was given, from its result."""
    return nested.select(key, F.inline("paragraphs")).select(key, "p", F.inline("sentences"))


def flatten_boards(boards: DataFrame, key: str) -> DataFrame:
    """Board records to bilingual sentence rows (key, p, s, zh, en)."""
    rows = boards.select(key, F.posexplode("paragraphs").alias("p", "para"))
    return rows.select(key, "p", F.posexplode("para.sentences").alias("s", "x")).select(key, "p", "s", "x.zh", "x.en")


def nest_boards(rows: DataFrame, key: str) -> DataFrame:
    """(key, p, s, zh, en) to board paragraphs with their sentences; paragraph texts are the sentences joined."""
    cell = F.array_sort(F.collect_list(F.struct("s", "zh", "en")))
    by_p = rows.groupBy(key, "p").agg(cell.alias("x"))
    sent = F.transform("x", lambda e: F.struct(e["zh"].alias("zh"), e["en"].alias("en")))
    side = lambda c, sep: F.array_join(F.transform("x", lambda e: e[c]), sep)
    by_p = by_p.select(key, F.struct("p", side("zh", "").alias("zh"), side("en", " ").alias("en"), sent.alias("sentences")).alias("para"))
    out = by_p.groupBy(key).agg(F.array_sort(F.collect_list("para")).alias("x"))
    return out.select(key, F.transform("x", lambda e: F.struct(e["zh"].alias("zh"), e["en"].alias("en"), e["sentences"].alias("sentences"))).alias("paragraphs"))
