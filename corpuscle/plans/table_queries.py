"""Kept sketches, table functions, and streams of candidates and verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import sketches
from ..session import materialise, scratch_root
from ..streaming import incremental
from .catalogue import _docs, _t
from .registry import query


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, true AS users_within, true AS median_within FROM events GROUP BY event_type")
def sketch_rollup(spark, sf):
    """Persons and the median value of a kind of event from kept sketches of its days, held against exact figures."""
    ev = _t(spark, sf, "events").select("event_type", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "user_id", "value")
    kept = materialise(sketches.sketched(ev, ["event_type", "day"], F.col("user_id"), F.col("value")), "sketches")
    rough = sketches.merged(kept, ["event_type"]).select("event_type", "n", sketches.distinct_items().alias("about"), sketches.quantile(0.5).alias("median"))
    # One row a kind goes back to the rows, to rank the estimate among them.
    low, high = (F.sum(F.when(c, 1).otherwise(0)) / F.count("value") for c in (F.col("value") < F.col("median"), F.col("value") <= F.col("median")))
    exact = ev.join(rough.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), low.alias("low"), high.alias("high"))
    out = rough.join(exact, "event_type")
    near = F.abs(F.col("about") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users")
    middle = (F.col("low") <= 0.5 + sketches.RANK_ERROR) & (F.col("high") >= 0.5 - sketches.RANK_ERROR)
    return out.select("event_type", "n", "users", near.alias("users_within"), middle.alias("median_within"))


@query("""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)
SELECT doc_id, lang, ordinal::BIGINT AS ordinal, md5(line) AS digest FROM l""")
def sql_lines(spark, sf):
    """Lines of all documents by a table function."""
    tables.register(spark)
    rows = spark.sql("SELECT * FROM lines_of(TABLE({docs}), 'text')", docs=_docs(spark, sf).select("doc_id", "lang", "text"))
    return rows.select("doc_id", "lang", "ordinal", F.md5("line").alias("digest"))


@query("""SELECT conv_id, count(*)::BIGINT AS n, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def sql_nested(spark, sf):
    """Turns of a conversation as one array by a table function."""
    tables.register(spark)
    rows = spark.sql(
        "SELECT conv_id, part, text FROM nested(TABLE({turns}) PARTITION BY conv_id ORDER BY (turn), 'text')", turns=_t(spark, sf, "conversations").select("conv_id", "turn", "text")
    )
    whole = rows.groupBy("conv_id").agg(F.sum(F.size("text")).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])).alias("text"))
    return whole.select("conv_id", "n", F.md5(F.array_join("text", "|", "")).alias("digest"))


@query("""WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS w)
SELECT c.user_id, c.event_id, p.event_id AS purchase_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 6 HOUR < (SELECT w FROM w)""")
def stream_verdicts(spark, sf):
    """Clicks as candidates and purchases as their verdicts, joined as streams; clicks whose time is not over yet are still open."""
    root = f"{scratch_root(spark)}/corpuscle/verdicts-{uuid.uuid4().hex}"
    schema = _t(spark, sf, "events").schema
    side = lambda kind: incremental.file_stream(spark, f"{sf}/events.parquet*", schema).where(F.col("event_type") == kind).withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = side("click").select("user_id", "event_id", "ts")
    bought = side("purchase").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    joined = incremental.verdicts_of(clicks, bought, "user_id", "ts", "bought", "6 hours")
    incremental.run_available(joined, incremental.once_per_batch(f"{root}/out"), f"{root}/checkpoint")
    return spark.read.schema(joined.schema).parquet(f"{root}/out").select("user_id", "event_id", "purchase_id")
