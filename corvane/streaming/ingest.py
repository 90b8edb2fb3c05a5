"""Structured Streaming where it stands for a loop: incremental ingest and idle sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.lifecycle import write_upsert


def incremental(spark: SparkSession, source: str, schema: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame], target: str, keys: list[str], pattern: str = "*.parquet") -> StreamingQuery:
    """Ingests the files that are new since the last run and upserts them into ``target``; the checkpoint remembers
    what was done, so a run after a failure goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        write_upsert(apply(batch), target, keys)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_sessions(events: DataFrame, key: str, time: str, timeout: str) -> DataFrame:
    """``key, start, end, n``: runs of events with no gap of ``timeout`` or more; works on batches and on streams
    (call ``withWatermark`` on a stream first)."""
    session = F.session_window(F.col(time).cast("timestamp"), timeout)
    rows = events.groupBy(key, session.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_stream(spark: SparkSession, source: str, schema: str, key: str, time: str, timeout: str, late: str, pattern: str = "events.parquet") -> DataFrame:
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return idle_sessions(stream, key, time, timeout)
