"""Structured Streaming: a work queue by state, and windows over events. Extensions of ours: the batch operators have no event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total by event time; rows later than the watermark are dropped by the stream, never by the batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n: runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, in micro-batches; a second call goes on after the first. checkpoint: a folder all executors share."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def work_queue(rows: DataFrame, state: str, wanted: str, step: Callable[[DataFrame], DataFrame], done: str) -> DataFrame:
    """Rows in the wanted state go through a step and come out in the done state; all others stay as they are. Works on batches and streams alike."""
    todo = F.col(state).eqNullSafe(F.lit(wanted))
    out = step(rows.where(todo)).withColumn(state, F.lit(done))
    return out.unionByName(rows.where(~todo))
