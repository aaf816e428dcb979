"""Kept sketches and table functions."""

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import tables
from corpuscle.operators import sketches


def test_merged_sketches_are_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("museum"), (F.col("id") * 7919 % 20_011).alias("item"), F.sqrt("id").alias("x"))
    days = sketches.sketched(rows, ["museum", "day"], F.col("item"), F.col("x"))
    got = {r.museum: r for r in sketches.merged(days, ["museum"]).select("museum", "n", sketches.distinct_items().alias("d"), sketches.quantile(0.9).alias("q")).collect()}
    for m, keep in (("a", lambda i: i % 3 == 0), ("b", lambda i: i % 3)):
        ids = [i for i in range(60_000) if keep(i)]
        d = len({i * 7919 % 20_011 for i in ids})
        assert got[m].n == len(ids) and abs(got[m].d - d) <= sketches.DISTINCT_ERROR * d
        assert abs(sum(i**0.5 <= got[m].q for i in ids) / len(ids) - 0.9) <= sketches.RANK_ERROR


def test_sketches_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None), (None, 1, 2.0), ("a", None, None), ("a", None, float("nan"))], "k string, item long, x double")
    got = {r.k: (r.n, r.d, r.q) for r in sketches.merged(sketches.sketched(df.where("x is null or not isnan(x)"), ["k"], F.col("item"), F.col("x")), ["k"]).select("k", "n", sketches.distinct_items().alias("d"), sketches.quantile(0.5).alias("q")).collect()}
    assert got == {None: (2, 1, 2.0), "a": (1, 0, None)}
    assert sketches.sketched(df.limit(0), ["k"], F.col("item"), F.col("x")).count() == 0


def test_lines_and_nested_of_any_table(spark, monkeypatch):
    tables.register(spark)
    df = spark.createDataFrame([(1, "x", "a\n\nb", 2), (1, "x", None, 1), (2, None, "", 1), (None, "z", "c", 5)], "id int, ordinal1 string, text string, n int")
    lines = spark.sql("SELECT * FROM lines_of(TABLE({d}), 'text')", d=df)
    assert lines.columns == ["id", "ordinal1", "n", "ordinal", "line"]
    assert sorted(map(tuple, lines.collect()), key=repr) == sorted([(1, "x", 2, 0, "a"), (1, "x", 2, 1, ""), (1, "x", 2, 2, "b"), (2, None, 1, 0, ""), (None, "z", 5, 0, "c")], key=repr)
    nested = spark.sql("SELECT id, part, text FROM nested(TABLE({d}) PARTITION BY id ORDER BY (n), 'text')", d=df)
    assert {(r.id, r.part, tuple(r.text)) for r in nested.collect()} == {(1, 0, (None, "a\n\nb")), (2, 0, ("",)), (None, 0, ("c",))}
    assert spark.sql("SELECT * FROM nested(TABLE({d}) PARTITION BY id ORDER BY (n), 'n')", d=df).schema["n"].dataType.simpleString() == "array<int>"
    assert spark.sql("SELECT * FROM lines_of(TABLE({d}), 'text')", d=df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM lines_of(TABLE({d}), 'nix')", d=df).collect()


def test_long_groups_come_in_parts(spark):
    tables.register(spark)
    df = spark.range(25_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    got = sorted((r.part, r.v) for r in spark.sql("SELECT * FROM nested(TABLE({d}) PARTITION BY k ORDER BY (v), 'v')", d=df).collect())
    assert [len(v) for _, v in got] == [10_000, 10_000, 5_000] and [x for _, v in got for x in v] == list(range(25_000))
