"""Approximate counts and quantiles that are kept: sketches of fixed size per group, merged later without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers (as a power of two) of a distinct count: relative standard error 1.04 / 2 ** (LG / 2), 1.6 %.
LG = 12
#: Size of a quantile sketch: rank error below 1 % with 99 % probability.
K = 400
#: Stated bounds: three standard errors of a distinct count (once more for the merge's looser estimate), and of a rank.
DISTINCT_ERROR, RANK_ERROR = 0.06, 0.02


def sketched(rows: DataFrame, by: list[str], item: Column, value: Column) -> DataFrame:
    """(by, n, items, values): a row a group, some KB each whatever its size.

    A hot group folds before the shuffle. Nulls are counted in ``n`` alone; a group without any value has null sketches
    there. Rows with a null in ``by`` are a group.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, LG).alias("items"), F.kll_sketch_agg_double(value.cast("double"), K).alias("values"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, in the same form."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def distinct_items() -> Column:
    return F.hll_sketch_estimate("items")


def quantile(q: float) -> Column:
    """Null where the group has no value."""
    return F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(q)))
