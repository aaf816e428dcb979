"""States of items over a table and over a stream of the same events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_root
from ..streaming import incremental, states
from .catalogue import _t
from .registry import query

_DAY = 86_400_000_000
_RULE = {"tries": 5, "patience_us": 3 * _DAY}

_DECIDED_SQL = """WITH b AS (SELECT (max(epoch_us(ts)) - {late}) // 1000 * 1000 AS w FROM events),
e AS (SELECT user_id::VARCHAR AS item, event_id, epoch_us(ts) AS us, event_type, w FROM events, b WHERE epoch_us(ts) < w),
o AS (SELECT *, lead(us) OVER i AS after, sum((event_type = 'error')::INT) OVER i AS failures, row_number() OVER i AS nth FROM e WINDOW i AS (PARTITION BY item ORDER BY us, event_id)),
s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' AND failures >= 5 THEN 'skipped' WHEN coalesce(after, w) - us > 259200000000 THEN 'expired' END AS status FROM o)
SELECT item, status, failures::INT AS failures, us + CASE WHEN status = 'expired' THEN 259200000000 ELSE 0 END AS at_us FROM s WHERE status IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY item ORDER BY nth) = 1"""


def _args():
    return ("user_id", "ts", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


def _shown(rows):
    return rows.select("item", "status", "failures", F.unix_micros("at").alias("at_us"))


@query(_DECIDED_SQL.format(late=0))
def review_states(spark, sf):
    """Persons as items, purchases as done, errors as failures."""
    return _shown(states.decided(_t(spark, sf, "events"), *_args(), **_RULE))


@query(_DECIDED_SQL.format(late=600_000_000))
def review_states_stream(spark, sf):
    """The same, by state kept over a stream that reads the table's file."""
    root = f"{scratch_root(spark)}/corpuscle/states-{uuid.uuid4().hex}"
    table = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = incremental.file_stream(spark, f"{sf}/events.parquet*", _t(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    with states.stored(spark):
        incremental.run_available(states.decisions(stream.select(table.columns), *_args(), **_RULE), incremental.once_per_batch(f"{root}/out"), f"{root}/checkpoint")
    return _shown(spark.read.schema(states.OUT).parquet(f"{root}/out"))
