"""Joins on order: spans that overlap, and the last row at or before each row.

``overlaps`` is a bucketed interval join. A span of length L has its home at the level whose bins are at least L wide
(each level's bins are ``BASE`` times those below), so it touches two bins there at most; it also shows itself on every
coarser level at which the other side has a home. Two spans meet on the coarser of their two home levels and are
reported in their first common bin alone, so nothing has to be made distinct, and no span is copied more than twice a
level, however long it is.

``last_before`` is an as-of join by global order. Both sides are cut into ranges of (keys, time) that may end inside a key
or a time; each range is scanned alone, and what it must know of the ranges before it is one row a range. A key that holds
a third of all rows is so spread over as many tasks as it is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BASE = 8
#: Rows of one side in one bin from which the bin is dealt out to several tasks.
HOT = 100_000
#: A level has bins of BASE ** level units; 20 levels reach 2 ** 60 units.
LEVELS = 20
_P = "__i_"


def _level(start: Column, end: Column) -> Column:
    """The first level whose bins are wider than end - start."""
    length = (end - start).cast("decimal(20,0)")
    return sum((F.when(length >= F.lit(BASE**k), 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def _bin(at: Column, level: Column) -> Column:
    """Floor division, below zero too."""
    return F.call_function("shiftright", at, (level * 3).cast("int"))


def _shown(side: DataFrame, levels: list[int], tag: str) -> DataFrame:
    """Each span in its bins: at home, and on the levels of ``levels`` above it."""
    p = _P
    home, at = F.col(p + tag + "home"), F.col(p + "level")
    above = F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k > home)
    df = side.withColumn(p + "level", F.explode(F.array_union(F.array(home), above)))
    bins = F.sequence(_bin(F.col(p + tag + "s"), at), _bin(F.col(p + tag + "e"), at))
    return df.withColumn(p + "bin", F.explode(bins))


def _levels(side: DataFrame, tag: str) -> list[int]:
    """LEVELS + 1 numbers at most."""
    return sorted(side.agg(F.collect_set(_P + tag + "home")).head()[0])


def overlaps(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    on: list[str] = (),
    hot: int = HOT,
) -> DataFrame:
    """The pairs of rows with equal ``on`` whose closed spans share a point: columns ``on``, then those of left, then of right.

    Bounds are whole numbers, or timestamps (taken in microseconds); a point is a span that ends where it starts. Spans
    with a null bound or key, or that end before they start, meet nothing. Repeated rows give repeated pairs. Apart from
    ``on`` the two sides must not share column names. Bins with more than ``hot`` rows of one side are dealt out: that
    side's rows at random, with the other side's rows copied to each share.
    """
    p, on = _P, list(on)
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if shared:
        raise ValueError(f"columns of both sides: {sorted(shared)}")

    def side(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        ends = [F.unix_micros(c) if df.schema[c].dataType.typeName() == "timestamp" else F.col(c).cast("long") for c in span]
        rows = df.withColumns({p + tag + "s": ends[0], p + tag + "e": ends[1]}).where(F.col(p + tag + "s") <= F.col(p + tag + "e"))
        rows = reduce(lambda d, c: d.where(F.col(c).isNotNull()), on, rows)
        return rows.withColumn(p + tag + "home", _level(F.col(p + tag + "s"), F.col(p + tag + "e")))

    a, b = side(left, left_span, "l"), side(right, right_span, "r")
    # Each side need only be shown on the levels at which the other has homes.
    la, lb = _levels(a, "l"), _levels(b, "r")
    a, b = _shown(a, lb, "l"), _shown(b, la, "r")
    bin_of = [*on, p + "level", p + "bin"]
    much = materialise(
        a.select(*bin_of, F.lit(1).alias("x"), F.lit(0).alias("y"))
        .unionByName(b.select(*bin_of, F.lit(0).alias("x"), F.lit(1).alias("y")))
        .groupBy(*bin_of)
        .agg(F.sum("x").alias(p + "nl"), F.sum("y").alias(p + "nr"))
        .where(f"greatest({p}nl, {p}nr) > {int(hot)} and least({p}nl, {p}nr) > 0"),
        "hot-bins",
    )
    larger = F.col(p + "nl") >= F.col(p + "nr")
    parts = F.coalesce(F.ceil(F.greatest(p + "nl", p + "nr") / hot).cast("int"), F.lit(1))

    def dealt(df: DataFrame, split: Column) -> DataFrame:
        df = df.join(much, bin_of, "left")
        own = F.array((F.rand(seed=1) * parts).cast("int"))
        return df.withColumn(p + "part", F.explode(F.when(F.coalesce(split, F.lit(True)), own).otherwise(F.sequence(F.lit(0), parts - 1)))).drop(p + "nl", p + "nr")

    met = dealt(a, larger).join(dealt(b, ~larger), [*bin_of, p + "part"])
    first = F.greatest(_bin(F.col(p + "ls"), F.col(p + "level")), _bin(F.col(p + "rs"), F.col(p + "level")))
    met = met.where(
        (F.greatest(p + "lhome", p + "rhome") == F.col(p + "level"))
        & (F.col(p + "bin") == first)
        & (F.col(p + "ls") <= F.col(p + "re"))
        & (F.col(p + "rs") <= F.col(p + "le"))
    )
    return met.select(*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on])


def last_before(
    left: DataFrame,
    right: DataFrame,
    time: str,
    right_time: str,
    on: list[str],
    tie: list[str] = (),
    tolerance=None,
) -> DataFrame:
    """left with the columns of the last right row of equal ``on`` whose ``right_time`` is at or before ``time``.

    Every left row is returned once, with nulls where there is no such row; so are left rows with a null time or key, which
    match nothing, and right rows with a null time or key are never matched. Of right rows of one time the greatest by
    ``tie`` is taken; rows equal in these too are taken in the order of all their columns' hash. ``tolerance`` (an interval for timestamps, else a number) is the
    greatest distance of a match. Apart from ``on`` the two sides must not share column names.
    """
    p, on = _P, list(on)
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if shared:
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    known = lambda df, t: reduce(lambda a, c: a & F.col(c).isNotNull(), [t, *on], F.lit(True))
    held = [c for c in right.columns if c not in on]
    mine = [c for c in left.columns if c not in on]
    rank = [p + f"t{k}" for k in range(len(tie))]
    empty = lambda df, cs: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cs]
    tail = F.xxhash64(*[F.col(c) for c in right.columns])
    rows = right.where(known(right, right_time)).select(
        *on, F.col(right_time).alias(p + "at"), F.lit(0).alias(p + "side"), *[F.col(c).alias(r) for c, r in zip(tie, rank)], tail.alias(p + "h"),
        F.struct(*held).alias(p + "r"), F.struct(*empty(left, mine)).alias(p + "l"),
    )
    asks = left.where(known(left, time)).select(
        *on, F.col(time).alias(p + "at"), F.lit(1).alias(p + "side"), *[F.lit(None).cast(right.schema[c].dataType).alias(r) for c, r in zip(tie, rank)],
        F.xxhash64(*[F.col(c) for c in left.columns]).alias(p + "h"),
        F.lit(None).cast(rows.schema[p + "r"].dataType).alias(p + "r"), F.struct(*mine).alias(p + "l"),
    )
    order = [*on, p + "at", p + "side", *rank, p + "h"]
    both = rows.unionByName(asks).repartitionByRange(*order)
    # The numbers of ranges are written with their rows: a range that is computed again elsewhere may be cut otherwise.
    both = materialise(both.withColumn(p + "range", F.spark_partition_id()), "ranges")

    within = Window.partitionBy(p + "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(*on) if on else F.lit(True)
    found = F.last(F.when(F.col(p + "side") == 0, F.struct(key.alias("k"), F.col(p + "at").alias("at"), F.col(p + "r").alias("r"))), True)
    scanned = both.withColumn(p + "f", found.over(within)).where(F.col(p + "side") == 1)
    # One row a range: the last right row in it, then that of all ranges before.
    ends = both.where(F.col(p + "side") == 0).groupBy(p + "range").agg(F.max_by(F.struct(key.alias("k"), F.col(p + "at").alias("at"), F.col(p + "r").alias("r")), F.struct(*order)).alias("end"))
    ranges = both.select(p + "range").distinct().join(ends, p + "range", "left")
    before = Window.orderBy(p + "range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(p + "range", F.last("end", True).over(before).alias(p + "c"))
    f = F.coalesce(p + "f", p + "c")
    out = scanned.join(carried, p + "range", "left").withColumn(p + "f", f)
    same = F.col(p + "f.k").eqNullSafe(key)
    if tolerance is not None:
        same &= F.col(p + "at") - F.col(p + "f.at") <= tolerance
    best = F.when(same, F.col(p + "f.r"))
    out = out.select(*on, F.col(p + "l.*"), best.alias(p + "b")).select(*on, *mine, *[F.col(p + "b")[c].alias(c) for c in held])
    rest = left.where(~known(left, time)).select(*on, *mine, *empty(right, held))
    return out.unionByName(rest)
