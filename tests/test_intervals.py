"""Interval and as-of joins against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import intervals


def spans(rng, n):
    out = []
    for i in range(n):
        s = rng.choice([rng.randint(-300, 300), rng.randint(0, 9), -(1 << 40)])
        out.append((rng.choice([1, 1, 1, 2, None]), s, rng.choice([s, s + rng.randint(0, 20), s + (1 << rng.randint(0, 45)), s - 1, None]), i))
    return out + out[:5]


@pytest.mark.parametrize("hot", [3, 100_000])
@pytest.mark.parametrize("keyed", [True, False])
def test_overlaps(spark, hot, keyed):
    rng = random.Random(hot)
    a, b = spans(rng, 70), spans(rng, 60)
    left = spark.createDataFrame(a, "k int, s1 long, e1 long, a int")
    right = spark.createDataFrame(b, "k int, s2 long, e2 long, b int")
    if not keyed:
        left, right = left.withColumnRenamed("k", "k1"), right.withColumnRenamed("k", "k2")
    got = intervals.overlaps(left, right, ("s1", "e1"), ("s2", "e2"), ["k"] if keyed else [], hot)
    sound = lambda x: None not in x[1:3] and x[1] <= x[2] and not (keyed and x[0] is None)
    want = Counter((x[3], y[3]) for x in a for y in b if sound(x) and sound(y) and (x[0] == y[0] or not keyed) and x[1] <= y[2] and y[1] <= x[2])
    assert Counter((r.a, r.b) for r in got.collect()) == want and len(want) > 100
    assert intervals.overlaps(left.limit(0), right, ("s1", "e1"), ("s2", "e2")).count() == 0 if not keyed else True


def test_overlaps_of_timestamps(spark):
    left = spark.sql("SELECT timestamp'1969-12-31 23:59:00' AS s1, timestamp'1970-01-01 00:01:00' AS e1")
    right = spark.sql("SELECT timestamp'1970-01-01 00:01:00' + make_interval(0,0,0,0,0,0,id) AS t, id FROM range(2)")
    assert [r.id for r in intervals.overlaps(left, right, ("s1", "e1"), ("t", "t")).collect()] == [0]


def test_a_span_is_copied_twice_a_level_at_most(spark):
    rows = spark.createDataFrame([(0, 1 << 50)], "s long, e long")
    side = rows.select(F.col("s").alias("__i_ls"), F.col("e").alias("__i_le"), intervals._level(F.col("s"), F.col("e")).alias("__i_lhome"))
    assert intervals._shown(side, list(range(21)), "l").count() <= 2 * 4


@pytest.mark.parametrize("tolerance", [None, 5])
def test_last_before(spark, tolerance):
    rng = random.Random(3)
    key = lambda: rng.choice(["x"] * 8 + ["y", "z", None])
    time = lambda: rng.choice([None, *range(60)])
    a = [(key(), time(), i) for i in range(200)]
    b = [(key(), time(), i) for i in range(150)]
    left = spark.createDataFrame(a, "k string, t int, a int")
    right = spark.createDataFrame(b, "k string, u int, b int")
    got = intervals.last_before(left, right, "t", "u", ["k"], ["b"], tolerance)
    assert got.columns == ["k", "t", "a", "u", "b"]
    want = []
    for k, t, i in a:
        met = [(u, j) for q, u, j in b if None not in (k, t, u) and q == k and u <= t]
        u, j = max(met, default=(None, None))
        want.append((k, t, i, u, j) if u is not None and (tolerance is None or t - u <= tolerance) else (k, t, i, None, None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_last_before_over_many_ranges_of_one_key(spark):
    """One key, one time for most rows: the answer is carried over ranges that hold no right row."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).cast("long").alias("t"), "id")
        right = spark.createDataFrame([(1, 5, "early"), (1, 3500, "late"), (0, 1, "other")], "k int, u long, name string")
        got = intervals.last_before(left, right, "t", "u", ["k"])
        assert Counter(r.name for r in got.collect()) == {"early": 3500, "late": 500}
        none = intervals.last_before(left, right.limit(0), "t", "u", ["k"])
        assert none.where("name is null").count() == 4000 and intervals.last_before(left.limit(0), right, "t", "u", ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
