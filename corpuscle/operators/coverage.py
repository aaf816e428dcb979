"""Coverage, completeness and corpus totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonblank, percent


def by_language(rows: DataFrame, unit: str, langs, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, completed, missing, coverage) over all units of rows, for every language of langs.

    One shuffle: a row of flags per unit, then one row of counts.
    """
    has = rows.groupBy(unit).agg(*[F.max(F.when((F.col(lang) == x) & nonblank(F.col(text)), 1).otherwise(0)).alias(x) for x in langs])
    sums = has.agg(F.count("*").alias("units"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in langs])
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(x).alias("completed")) for x in langs]))
    out = sums.select("units", grid.alias("g")).select("g.lang", "g.completed", (F.col("units") - F.col("g.completed")).alias("missing"))
    return out.withColumn("coverage", percent(F.col("completed"), F.col("completed") + F.col("missing")))


def by_group_and_language(rows: DataFrame, group: str, langs, lang: str = "lang", text: str = "text") -> DataFrame:
    """The full grid group x lang: rows of a group in that language, and the rest of the group."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if((F.col(lang) == x) & nonblank(F.col(text))).alias(x) for x in langs])
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(x).alias("completed")) for x in langs]))
    out = per.select(group, "n", grid.alias("g")).select(group, "g.lang", "g.completed", (F.col("n") - F.col("g.completed")).alias("missing"))
    return out.withColumn("coverage", percent(F.col("completed"), F.col("completed") + F.col("missing")))


def unit_languages(rows: DataFrame, unit: str, langs, lang: str = "lang", text: str = "text") -> DataFrame:
    """(unit, filled array in order, n_langs, complete)."""
    filled = F.array_sort(F.collect_set(F.when(nonblank(F.col(text)), F.col(lang))))
    out = rows.groupBy(unit).agg(filled.alias("filled"))
    return out.withColumns({"n_langs": F.size("filled").cast("long"), "complete": F.size(F.array_intersect("filled", F.array(*[F.lit(x) for x in langs]))) == len(langs)})


def totals(docs: DataFrame, **measures) -> DataFrame:
    """One row of named aggregates."""
    return docs.agg(*[m.alias(k) for k, m in measures.items()])


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share of all): the window runs over the few groups, not the rows."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()).cast("double"))


def funnel(*stages: tuple[str, DataFrame]) -> DataFrame:
    """(ordinal, stage, n, rate): rows of each stage and the rate kept from the one before."""
    counts = None
    for k, (name, df) in enumerate(stages):
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).cast("long").alias("ordinal"), F.lit(name).alias("stage"), "n")
        counts = one if counts is None else counts.unionByName(one)
    before = F.lag("n").over(Window.orderBy("ordinal"))
    return counts.withColumn("rate", F.try_divide(F.col("n").cast("double"), before.cast("double")))


def alignment_rate(rows: DataFrame, by: str, aligned: str) -> DataFrame:
    """(by, n, aligned, rate)."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(aligned)).alias("aligned"))
    return out.withColumn("rate", percent(F.col("aligned"), F.col("n")))
