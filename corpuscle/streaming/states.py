"""State kept per item over a stream: attempts, reviews and waiting times.

An item is *done* at its first ``done`` event, *skipped* at its ``tries``-th failure, and *expired* once ``patience`` passes
after its last event without another; what comes first decides, and later events of the item are ignored. Events are
taken in order of time, then of ``seq``, whatever order they arrive in: the stream holds them back until the watermark has
passed them. Only events before the watermark count, so that a stream which has read all its input ends with
``decided(events, ..., until)`` where ``until`` is its watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

OUT = "item string, status string, failures int, at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(events: DataFrame, item: str, time: str, seq: str, done: Column, failed: Column) -> DataFrame:
    """(item, us, seq, kind, ts), kind: d, f or o for others; rows with a null item or time have no place in order and go."""
    kind = F.when(done, "d").when(failed, "f").otherwise("o")
    ts = F.col(time).cast("timestamp")
    out = events.select(F.col(item).cast("string").alias("item"), F.unix_micros(ts).alias("us"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("seq"), kind.alias("kind"), ts.alias("ts"))
    return out.where("item is not null and us is not null")


def decided(events: DataFrame, item: str, time: str, seq: str, done: Column, failed: Column, tries: int, patience_us: int, until: Column | None = None) -> DataFrame:
    """(item, status, failures, at) of the items decided before ``until`` (by default the last time, cut to milliseconds), over a table.

    Items that are still open have no row. An item's events pass through one task in order, without being held there.
    """
    rows = _events(events, item, time, seq, done, failed)
    end = rows.agg(F.coalesce(F.unix_micros(until), F.floor(F.max("us") / 1000) * 1000) if until is not None else (F.floor(F.max("us") / 1000) * 1000)).head()[0]
    rows = rows.where(F.col("us") < F.lit(end))
    order = Window.partitionBy("item").orderBy("us", "seq", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"before": F.lag("us").over(order), "after": F.lead("us").over(order), "fails": F.sum(F.when(F.col("kind") == "f", 1).otherwise(0)).over(so_far), "nth": F.row_number().over(order)})
    gone = F.coalesce(F.col("after"), F.lit(end)) - F.col("us") > patience_us
    status = F.when(F.col("kind") == "d", "done").when((F.col("kind") == "f") & (F.col("fails") >= tries), "skipped").when(gone, "expired")
    at = F.when(status == "expired", F.col("us") + patience_us).otherwise(F.col("us"))
    ends = rows.select("item", "nth", status.alias("status"), F.col("fails").cast("int").alias("failures"), F.timestamp_micros(at).alias("at")).where("status is not null")
    return ends.groupBy("item").agg(F.min_by(F.struct("status", "failures", "at"), "nth").alias("x")).select("item", "x.*")


class _Items(StatefulProcessor):
    """Per item: how it stands, and the events that the watermark has not passed."""

    def __init__(self, tries: int, patience_us: int):
        self.tries, self.patience = tries, patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stand = handle.getValueState("stand", "last long, failures int, decided boolean")
        self.waiting = handle.getListState("waiting", "us long, seq long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not (self.stand.exists() and self.stand.get()[2]):
            first = None
            for pdf in rows:
                self.waiting.appendList([(int(u), int(s), str(k)) for u, s, k in zip(pdf["us"], pdf["seq"], pdf["kind"])])
                first = min(int(pdf["us"].min()), first if first is not None else int(pdf["us"].min()))
            if first is not None:
                self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = timerValues.getCurrentWatermarkInMs() * 1000
        last, failures, over = self.stand.get() if self.stand.exists() else (None, 0, False)
        if over:
            return
        events = sorted(tuple(x) for x in self.waiting.get())
        ready, later = [e for e in events if e[0] < end], [e for e in events if e[0] >= end]
        status, at = None, None
        for us, _, kind in ready:
            if last is not None and us - last > self.patience:
                break
            last, failures = us, failures + (kind == "f")
            if kind == "d" or (kind == "f" and failures >= self.tries):
                status, at = ("done" if kind == "d" else "skipped"), us
                break
        else:
            us = None
        if status is None and last is not None and (us if us is not None else end) - last > self.patience:
            status, at = "expired", last + self.patience
        self.stand.update((last, failures, status is not None))
        self.waiting.clear()
        if status is not None:
            yield pd.DataFrame({"item": [key[0]], "status": [status], "failures": pd.array([failures], "int32"), "at": pd.to_datetime([at], unit="us")})
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        if last is not None:
            self.handle.registerTimer((last + self.patience) // 1000 + 1)

    def close(self) -> None:
        pass


def decisions(events: DataFrame, item: str, time: str, seq: str, done: Column, failed: Column, tries: int, patience_us: int, late: str = "10 minutes") -> DataFrame:
    """``decided`` over a stream: a row for each item when it is decided. Run it within ``stored``.

    State is one short row for each item ever seen (a decided item must stay known, so that later events do not open it
    anew), and the events of undecided items of the last ``late``. Rows that come when the watermark has reached them are dropped;
    ``incremental.split_late`` keeps them.
    """
    ship(events.sparkSession)
    rows = _events(events, item, time, seq, done, failed).withWatermark("ts", late)
    return rows.groupBy("item").transformWithStateInPandas(_Items(tries, patience_us), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


@contextmanager
def stored(spark: SparkSession):
    """State of streams started here lies in RocksDB, which this kind of state needs; the session's setting is put back."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old) if old else spark.conf.unset(_PROVIDER)
