"""Events against spans of time, and against the last event before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from .catalogue import _t
from .registry import query


@query("""WITH s AS (SELECT user_id, event_id AS error_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 600000000)::BIGINT AS e FROM events WHERE event_type = 'error'),
v AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 1000000)::BIGINT AS e FROM events WHERE event_type != 'error')
SELECT user_id, error_id, event_id FROM s JOIN v USING (user_id) WHERE s.s <= v.e AND v.s <= s.e""")
def span_overlaps(spark, sf):
    """Events that fall into the time that follows an error of the same person."""
    ev = _t(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    end = lambda unit: F.col("us") + F.round(F.col("value") * unit).cast("long")
    errors = ev.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("us").alias("s1"), end(600_000_000).alias("e1"))
    others = ev.where("event_type != 'error'").select("user_id", "event_id", F.col("us").alias("s2"), end(1_000_000).alias("e2"))
    return intervals.overlaps(errors, others, ("s1", "e1"), ("s2", "e2"), ["user_id"]).select("user_id", "error_id", "event_id")


@query("""WITH s AS (SELECT event_id AS error_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 1000000)::BIGINT AS e FROM events WHERE event_type = 'error')
SELECT error_id, event_id FROM s JOIN events v ON epoch_us(v.ts) BETWEEN s.s AND s.e WHERE v.event_type != 'error'""")
def points_in_spans(spark, sf):
    """The same over all persons, with a span against points and no equal key."""
    ev = _t(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    errors = ev.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("us").alias("s1"), (F.col("us") + F.round(F.col("value") * 1_000_000).cast("long")).alias("e1"))
    return intervals.overlaps(errors, ev.where("event_type != 'error'").select("event_id", "us"), ("s1", "e1"), ("us", "us")).select("error_id", "event_id")


@query("""WITH r AS (SELECT user_id, ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.user_id, e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(r.click_ts) <= 86400000000 THEN r.click_id END AS click_id
FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.click_ts""")
def last_click_before(spark, sf):
    """For every event the last click of the same person in the day before it, itself included."""
    ev = _t(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    clicks = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("us").alias("click_us"))
    out = intervals.last_before(ev.drop("event_type"), clicks, "us", "click_us", ["user_id"], ["click_id"], tolerance=86_400_000_000)
    return out.select("user_id", "event_id", "click_id")
