"""Resumable runs: a file stream with a checkpoint takes each item once, in as many runs as it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there and stop. A batch that failed is offered again under its number; what a run has
    committed is not offered to the next."""
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def windowed_counts(source: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, by, n) per time window, with a watermark for late rows when source is a stream."""
    rows = source.withColumn(time, F.col(time).cast("timestamp"))
    if source.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(F.window(time, width, slide or width).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def sessions(source: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n) of bursts without a pause of ``gap``."""
    rows = source.withColumn(time, F.col(time).cast("timestamp"))
    if source.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def split_late(source: DataFrame, time: str, late: str, on_time_path: str, late_path: str, checkpoint: str) -> None:
    """Take what is there: rows less than ``late`` (an interval) behind the greatest time of earlier batches go to
    ``on_time_path``, others, and those without a time, to ``late_path``, both in a folder a batch.

    The greatest time of each batch is kept beside its rows, so that a batch which is offered again is split as before.
    Streams that read ``on_time_path`` with the same or a longer delay lose no row to their watermarks.
    """
    spark = source.sparkSession
    seen_path = checkpoint.rstrip("/") + "-times"

    def split(batch: DataFrame, number: int) -> None:
        # One row a batch; the folder of this number may be left over from an attempt that failed.
        folder = spark._jvm.org.apache.hadoop.fs.Path(seen_path)
        known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        before = spark.read.schema("top timestamp, batch long").parquet(seen_path).where(F.col("batch") < number).agg(F.max("top")).head()[0] if known else None
        t = F.col(time).cast("timestamp")
        behind = t.isNull() | F.coalesce(t <= F.lit(before).cast("timestamp") - F.expr(f"interval {late}"), F.lit(False))
        batch = batch.withColumn("__behind", behind)
        batch.where("not __behind").drop("__behind").write.mode("overwrite").parquet(f"{on_time_path}/batch={number}")
        batch.where("__behind").drop("__behind").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.agg(F.max(t).alias("top")).write.mode("overwrite").parquet(f"{seen_path}/batch={number}")

    run_available(source, split, checkpoint)


def verdicts_of(candidates: DataFrame, verdicts: DataFrame, key: str, time: str, verdict_time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """candidates with the columns of their verdicts, which come at most ``within`` after them; without any, nulls.

    Two streams under watermarks: a candidate waits for ``within`` and ``late``, then goes out alone. Over tables the
    same rows come at once. The sides share no column but ``key``.
    """
    given = [c for c in verdicts.columns if c != key]
    v = verdicts.withColumnRenamed(key, "__key")
    if candidates.isStreaming:
        candidates, v = candidates.withWatermark(time, late), v.withWatermark(verdict_time, late)
    near = F.col(verdict_time).between(F.col(time), F.col(time) + F.expr(f"interval {within}"))
    return candidates.join(v, (F.col(key) == F.col("__key")) & near, "left").select(*candidates.columns, *given)
