"""Gaps: fill from repairs, merge partial records, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank


def fill(rows: DataFrame, repairs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """rows with ``final`` and ``method``: the original wins over a rule's repair, that over a model's.

    repairs: keys, method ('rule' or 'model'), text.
    """
    side = lambda m: repairs.where(F.col("method") == m).groupBy(*keys).agg(F.min(text).alias(m))
    out = rows.join(side("rule"), keys, "left").join(side("model"), keys, "left")
    given = F.when(nonblank(F.col(text)), F.col(text))
    method = F.when(given.isNotNull(), "original").when(F.col("rule").isNotNull(), "rule").when(F.col("model").isNotNull(), "model").otherwise("none")
    return out.withColumns({"final": F.coalesce(given, "rule", "model"), "method": method}).drop("rule", "model")


def merge_partial(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: for each column the first value that isn't null, by ``order``."""
    cols = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def pending(items: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """items that have no finished record."""
    return items.join(finished.select(key).where(F.col(key).isNotNull()), key, "left_anti")
