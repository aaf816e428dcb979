"""Choice between competing candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(candidates: DataFrame, keys: list[str], score: str, tie: str, *keep: str, n: str | None = None) -> DataFrame:
    """The best candidate of each key: highest score, then least ``tie``; null scores lose. n: for how many candidates a row stands.

    A partial aggregate: groups of any size are folded before the shuffle.
    """
    rank = F.struct(F.col(score).isNotNull().alias("s0"), F.col(score).alias("s1"), (-F.col(tie)).alias("s2"))
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(tie, score, *keep), rank).alias("x"), (F.sum(n) if n else F.count("*")).alias("n_candidates")).select(*keys, "x.*", "n_candidates")


def judge_by_verdicts(candidates: DataFrame, verdicts: DataFrame, keys: list[str], choice: str, score: str, *keep: str) -> DataFrame:
    """As judge(), where a verdict (keys, choice) names the winner; ``judged`` tells where one did. A verdict for no
    candidate leaves the choice to the scores; of several verdicts of a key any that names a candidate does."""
    named = verdicts.select(*keys, choice, F.lit(True).alias("named")).distinct()
    known = candidates.join(named, [*keys, choice], "left")
    rank = F.struct(F.coalesce("named", F.lit(False)).alias("s"), F.col(score).isNotNull().alias("s0"), F.col(score).alias("s1"), (-F.col(choice)).alias("s2"))
    best = F.max_by(F.struct(choice, score, *keep), rank).alias("x")
    by = known.groupBy(*keys).agg(best, F.count("*").alias("n_candidates"), F.coalesce(F.bool_or("named"), F.lit(False)).alias("judged"))
    return by.select(*keys, "x.*", "n_candidates", "judged")


def win_rates(candidates: DataFrame, winners: DataFrame, keys: list[str], model: str, tie: str) -> DataFrame:
    """(model, n, wins, rate) of each model's candidates."""
    won = winners.select(*keys, tie, F.lit(True).alias("won"))
    rows = candidates.join(won, [*keys, tie], "left").groupBy(model).agg(F.count("*").alias("n"), F.count_if("won").alias("wins"))
    return rows.withColumn("rate", F.col("wins").cast("double") / F.col("n").cast("double"))


def self_preference(winners: DataFrame, lang: str, model: str, judge_model: str) -> DataFrame:
    """(lang, n, own): how often a judge chose its own candidate."""
    return winners.groupBy(lang).agg(F.count("*").alias("n"), F.count_if(F.col(model) == F.col(judge_model)).alias("own"))
