"""Confidence grades, review overlay, board flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import length_ratio, nonblank

LOW, HIGH = 0.8, 0.9
#: Translations shorter than this share of the source count as abbreviated (our default).
ABBREVIATED = 0.5
GRADES = ("A", "B", "C", "U")


def grade(confidence: Column, reviewed: Column, low: float = LOW, high: float = HIGH) -> Column:
    """A: reviewed; B: low <= confidence <= high; C: below low; U: above high or unknown, not reviewed."""
    return F.when(F.coalesce(reviewed, F.lit(False)), "A").when(confidence.between(low, high), "B").when(confidence < low, "C").otherwise("U")


def at_least(grades: Column, least: str) -> Column:
    return grades.isin(*GRADES[: GRADES.index(least) + 1])


def latest(rows: DataFrame, item: str, *order: Column) -> DataFrame:
    """The last row of each item by the given order (a total one makes it deterministic).

    A maximum with partial aggregation, so an item with very many rows is folded before the shuffle.
    """
    rest = [c for c in rows.columns if c != item]
    keyed = rows.withColumns({f"__o{k}": o for k, o in enumerate(order)})
    best = keyed.groupBy(item).agg(F.max_by(F.struct(*rest), F.struct(*[f"__o{k}" for k in range(len(order))])).alias("x"))
    return best.select(item, "x.*")


def first_by_window(rows: DataFrame, item: str, *order: Column) -> DataFrame:
    """As latest(), by a window, where all ties' order columns can't be packed in one maximum."""
    n = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def review_overlay(items: DataFrame, reviews: DataFrame, key: str, text: str = "text") -> DataFrame:
    """items with ``action`` and ``final``: confirm keeps, correct replaces, skip drops the item; unreviewed ones stay."""
    joined = items.join(reviews.select(key, "action", "corrected_text"), key, "left").where("action is null or action != 'skip'")
    final = F.when(F.col("action") == "correct", F.coalesce("corrected_text", text)).otherwise(F.col(text))
    return joined.withColumn("final", final).drop("corrected_text")


def pair_flags(pairs: DataFrame, a: str, b: str, ratio: float = ABBREVIATED) -> DataFrame:
    """pairs with perfect, monolingual, abbreviated."""
    x, y = nonblank(F.col(a)), nonblank(F.col(b))
    short = F.coalesce(length_ratio(F.col(a), F.col(b)) < ratio, F.lit(False))
    return pairs.withColumns({"perfect": x & y, "monolingual": x != y, "abbreviated": x & y & short})


def board_flags(pairs: DataFrame, board: str) -> DataFrame:
    """Independent flags per board: all pairs perfect; some pair monolingual; some pair abbreviated."""
    return pairs.groupBy(board).agg(F.bool_and("perfect").alias("perfect"), F.bool_or("monolingual").alias("monolingual"), F.bool_or("abbreviated").alias("abbreviated"))


def corrections_count(boards: DataFrame) -> DataFrame:
    """boards with n_zh_changes and n_en_changes; boards without corrections have 0."""
    n = lambda side: F.coalesce(F.size(F.col("corrections")[f"{side}_changes"]), F.lit(0)).cast("long")
    out = boards.withColumns({f"n_{side}_changes": n(side) for side in ("zh", "en")})
    return out.withColumns({c: F.greatest(c, F.lit(0)) for c in ("n_zh_changes", "n_en_changes")})
