"""Operator 2: mix sources to target weights by hash-threshold histograms.

Targets come from water-filling over one row per source. Each document has a uniform 60-bit hash; a source
that is to give ``whole`` full copies of everything and ``rest`` further words takes the documents with
hashes below a threshold. The threshold is found by summing sizes into 4,096 hash buckets per source,
keeping the bucket in which the running sum passes the budget, and splitting only that bucket again: five
nested levels resolve all 60 bits. No document is sorted, and each level's histogram has at most 4,096 rows
for each source.

Defined results: null or empty text has size 0, takes 0 and is not in the mixed rows; null source is one source, last in order; null
doc_id is an ordinary value; rows that repeat doc_id and text have one hash and are taken or left together
where they stand on the threshold; an empty table gives an empty result; a clashing column name in docs is
kept in ``mix`` (own columns carry the prefix ``__m_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .columns import apart
from .words import count_words

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BUCKET_BITS = 12
HASH_BITS = 60
_P = "__m_"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size and the 60-bit hash of (doc_id, text); md5, so that SQL engines can repeat it."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return docs.withColumns(
        {
            _P + "size": count_words(F.col("text")),
            _P + "hash": F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long"),
        }
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """One row per source: size, target. Water-filling: the sources with the lowest cap per weight stop first.

    Works on the grouped sources only (one row each).
    """
    per = sizes.groupBy("source").agg(F.sum(_P + "size").alias("s"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", (F.col("s") * MAX_COPIES).cast("double"))
    asc = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = per.withColumns(
        {
            "total": F.sum("s").over(every) * F.lit(float(share)),
            "below": F.sum("cap").over(asc.rowsBetween(Window.unboundedPreceding, -1)),
            "wleft": F.sum("w").over(asc.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.coalesce("below", F.lit(0.0))) / F.col("wleft")
    level = F.when(level <= F.col("cap") / F.col("w"), level)
    per = per.withColumn("level", F.max(level).over(every))
    free = F.col("cap") / F.col("w") >= F.col("level")
    return per.select("source", F.col("s").alias("source_size"), F.when(free, F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, source_size, target) with ``whole`` copies of all and ``cut``: hashes below it are taken once more.

    The first level reads the sizes and hashes of all documents; those in the sources' boundary buckets, one in 4,096 or
    so, are written apart, and the levels below read no others.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = budgets.withColumns({"whole": whole}).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("cut", F.lit(0).cast("long"))
    live = sizes.select(F.col("source").alias("src"), F.col(_P + "size").alias("size"), F.col(_P + "hash").alias("hash"))
    for level in range(1, HASH_BITS // BUCKET_BITS + 1):
        shift = HASH_BITS - BUCKET_BITS * level
        last = shift == 0
        top = F.lit((1 << 62) - 1)
        bounds = state.select(F.col("source").alias("b_src"), "rest", "cut")
        inside = F.col("src").eqNullSafe(F.col("b_src"))
        if level > 1:
            inside &= F.shiftright("hash", shift + BUCKET_BITS) == F.shiftright("cut", shift + BUCKET_BITS)
        if level == 2:
            live = materialise(live.join(bounds.select("b_src", "cut"), inside).select("src", "size", "hash"), "mix-boundary")
        hist = (
            live.join(bounds, inside)
            .groupBy("b_src", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        )
        run = F.sum("size").over(Window.partitionBy("b_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        hist = hist.withColumn("before", F.coalesce(run, F.lit(0)))
        # The last bucket whose predecessors fit; at full resolution it is taken if that comes nearer.
        edge = hist.where(F.col("before") <= F.col("rest")).groupBy("b_src").agg(F.max(F.struct("bucket", "before", "size")).alias("e"))
        near = F.abs(F.col("e.before") + F.col("e.size") - F.col("rest")) <= F.abs(F.col("e.before") - F.col("rest"))
        cut = F.shiftleft(F.col("e.bucket"), shift)
        if last:
            cut = F.when(near & (F.col("rest") > 0), cut + 1).otherwise(cut)
        joined = state.join(edge, state["source"].eqNullSafe(edge["b_src"]), "left")
        state = joined.select(
            "source", "source_size", "target", "whole",
            (F.col("rest") - F.coalesce(F.col("e.before"), F.lit(0))).alias("rest"),
            F.coalesce(cut, F.lit(0)).alias("cut"),
        )
        state = materialise(state, f"mix-level{level}")
    return state


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(sizes, state): the narrow table of sizes and hashes, written once, and the sources' thresholds."""
    sizes = materialise(sized(docs).select("doc_id", "source", _P + "size", _P + "hash"), "mix-sizes")
    return sizes, thresholds(sizes, materialise(targets(sizes, weights, share), "mix-targets"))


def _copies():
    return F.col("whole") + F.when(F.col(_P + "hash") < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """The mixed rows: each row of docs as often as it is taken, with the columns of docs."""
    return apart(docs, _P, lambda d: _mixed(d, weights, share))


def _mixed(docs: DataFrame, weights, share: float) -> DataFrame:
    _, state = plan_mix(docs, weights, share)
    state = state.select(F.col("source").alias(_P + "src"), "whole", "cut").withColumnsRenamed({"whole": _P + "whole", "cut": _P + "cut"})
    rows = sized(docs)
    rows = rows.join(state, rows["source"].eqNullSafe(state[_P + "src"]))
    n = F.col(_P + "whole") + F.when(F.col(_P + "hash") < F.col(_P + "cut"), 1).otherwise(0)
    rows = rows.withColumn(_P + "n", n.cast("int")).where((F.col(_P + "n") > 0) & (F.col(_P + "size") > 0))
    rows = rows.withColumn(_P + "k", F.explode(F.sequence(F.lit(1), F.col(_P + "n"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sizes, state = plan_mix(docs)
    state = state.withColumnRenamed("source", "src")
    return sizes.join(state, sizes["source"].eqNullSafe(state["src"])).select(
        "doc_id",
        F.col(_P + "size").alias("size"),
        "source_size",
        "target",
        (F.col(_P + "size") * _copies()).alias("taken"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0 * s / w AS r, 3.0 * s AS cap, sum(s) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
k AS (SELECT *, max(CASE WHEN lev <= r THEN lev END) OVER () AS lam FROM l),
t AS (SELECT source, s AS source_size, (CASE WHEN r >= lam THEN lam * w ELSE cap END)::DOUBLE AS target FROM k),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
y AS (SELECT *, upto - own <= rest AS fits, max(CASE WHEN upto - own <= rest THEN h END) OVER (PARTITION BY source) AS edge FROM x)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN h < edge OR (h = edge AND rest > 0 AND abs(upto - rest) <= abs(upto - own - rest)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM y
"""
