"""Alignment units: long, wide and map forms, and the root document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank


def explode_translations(units: DataFrame, langs) -> DataFrame:
    """Units with a ``translations`` map to (id, lang, text) for every language of langs; absent ones null."""
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.element_at("translations", x).alias("text")) for x in langs]))
    return units.select("id", grid.alias("x")).select("id", "x.lang", "x.text")


def to_map(rows: DataFrame, key: str, lang: str = "lang", value: str = "text") -> DataFrame:
    """Long rows to one map per key; of several rows of a language the least value stands."""
    one = rows.groupBy(key, lang).agg(F.min(value).alias(value))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(lang, value)))).alias("translations"))


def to_wide(rows: DataFrame, key: str, langs, lang: str = "lang", value: str = "text") -> DataFrame:
    """One column per language of an explicit list."""
    return rows.groupBy(key).agg(*[F.min(F.when(F.col(lang) == x, F.col(value))).alias(x) for x in langs])


def attach(units: DataFrame, *targets: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join of per-language tables on the unit key."""
    for t in targets:
        units = units.join(t, key, "full_outer")
    return units


def complete(translations: Column, langs) -> Column:
    """Every language is there and not blank."""
    return F.forall(F.array(*[F.lit(x) for x in langs]), lambda x: nonblank(F.element_at(translations, x)))


def missing(filled: Column, langs) -> Column:
    """Languages of langs (in order) that are not in the array ``filled``."""
    return F.array_except(F.array(*[F.lit(x) for x in langs]), filled)


def root_document(units: DataFrame, corpus_id: str, name: str, version: str, created: str, langs) -> DataFrame:
    """One row: the whole corpus as one JSON text. A single task by nature; for export only."""
    body = units.agg(F.collect_list(F.struct("id", "source", "translations")).alias("alignment_units"))
    head = [F.lit(corpus_id).alias("corpus_id"), F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(created).alias("created"), F.array(*[F.lit(x) for x in langs]).alias("languages")]
    return body.select(F.to_json(F.struct(*head, "alignment_units")).alias("json"))
