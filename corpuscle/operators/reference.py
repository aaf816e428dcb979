"""Glossary and gold texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .glossary import term_places
from .vectors import nearest as nearest

GRAM = 4


def glossary_hits(docs: DataFrame, terms: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, term) for each of a fixed list of terms that the text holds: a filter in each row, no join."""
    held = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(text), t))
    return docs.select(key, F.explode(held).alias("term"))


def _held(docs: DataFrame, items: DataFrame, grams: Column, key: str, text: str, needle: str) -> DataFrame:
    """(key, the columns of items) where the text holds ``needle``; ``grams``: those of a text, one of which is the
    item's ``gram`` if the text holds it.

    Only keys and grams meet; texts are fetched for the pairs that are left.
    """
    rows = docs.select(key, F.explode(F.array_distinct(grams)).alias("gram"))
    near = rows.join(items, "gram").drop("gram").distinct()
    return docs.select(key, text).join(near, key).where(F.contains(F.col(text), F.col(needle))).drop(text).distinct()


def glossary_lookup(docs: DataFrame, glossary: DataFrame, key: str, term: str, text: str = "text") -> DataFrame:
    """(key, the columns of glossary) for each of the glossary's terms that the text holds.

    Texts run through an automaton of the terms (glossary.term_places); only keys and the terms found meet the glossary's
    rows. Empty and null terms are in no text.
    """
    held = term_places(docs, glossary, [key], text, term).select(key, F.col("term").alias("__held")).distinct()
    rows = held.join(glossary, F.col("__held") == F.col(term)).drop("__held")
    return rows.distinct()


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def gold_containment(docs: DataFrame, gold: DataFrame, key: str, item: str, text: str = "text") -> DataFrame:
    """(key, item) where the text holds the gold text literally.

    A held passage's inner words stand in the text as whole words, so texts and passages meet on a hash of the
    GRAM words after a passage's first; the literal test follows. Only keys and hashes meet, and texts are fetched for
    the pairs that are left. Passages with too few words for a gram meet texts on their characters (glossary_lookup).
    """
    w = _words(F.col(text))
    # Not trusted where the gram would reach the passage's last, perhaps partial word.
    gram = F.when(F.size(w) >= GRAM + 2, F.xxhash64(F.array_join(F.slice(w, 2, GRAM), " ")))
    keyed = gold.select(item, F.col(text).alias("gold"), gram.alias("gram"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - GRAM + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, GRAM), " ")))
    wide = docs.select(key, text, w.alias("w")).where(F.size("w") >= GRAM)
    long = _held(wide, keyed.where("gram is not null"), grams, key, text, "gold").select(key, item)
    few = keyed.where("gram is null and gold is not null").drop("gram")
    if few.limit(1).count():
        long = long.unionByName(glossary_lookup(docs, few, key, "gold", text).select(key, item))
        # Every text holds the empty passage.
        long = long.unionByName(docs.where(F.col(text).isNotNull()).select(key).join(few.where("gold = ''").select(item)))
    return long.distinct()


def gold_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ``similarity`` = 1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return pairs.withColumn("similarity", 1.0 - F.try_divide(F.levenshtein(F.col(a), F.col(b)).cast("double"), longer.cast("double")))
