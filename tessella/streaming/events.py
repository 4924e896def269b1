"""Streams of events (an extension): windows, sessions, deduplication, per-user running state; batch forms for comparison."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A file stream of a Parquet folder or file; session time stamps, so that watermarks apply."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum for each window and type; on a stream, rows later than the watermark are left out."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def unique(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """Per user: events so far and their total, kept in state between batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def sessions_by_gap(events: DataFrame, seconds: int = 1800) -> DataFrame:
    """Batch sessions from gaps between a user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at: Any = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(w)) >= seconds * 1_000_000, F.lit(True))
    marked = events.withColumn("session", F.sum(fresh.cast("long")).over(w))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).drop("session")
