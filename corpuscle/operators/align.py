"""Pairing of neighbouring sides, evidence and speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacent_pairs(rows: DataFrame, group: str, order: str, side: str, text: str, first: str, second: str) -> DataFrame:
    """Each ``first`` row with the ``second`` row right behind it in its group; null where another side follows."""
    w = Window.partitionBy(group).orderBy(order)
    ahead = rows.withColumns({"__side": F.lead(side).over(w), "__text": F.lead(text).over(w)})
    return ahead.where(F.col(side) == first).select(group, order, F.col(text).alias("a"), F.when(F.col("__side") == second, F.col("__text")).alias("b"))


def by_key(a: DataFrame, b: DataFrame, keys, how: str = "full_outer") -> DataFrame:
    return a.join(b, keys, how)


def evidence(images: DataFrame, texts: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, both readings and whether they agree (null-safe)."""
    return images.join(texts, key).withColumn("agree", F.col(a).eqNullSafe(F.col(b)))


def speech(units: DataFrame, segments: DataFrame) -> DataFrame:
    """units (unit_id, lang, ordinal) with the segment (lang, ordinal, start_s, end_s) of the same place, if any."""
    return units.join(segments, ["lang", "ordinal"], "left").withColumn("aligned", F.col("start_s").isNotNull() & (F.col("end_s") >= F.col("start_s")))
