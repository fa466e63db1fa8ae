"""The event log as a stream: windowed counts, sessions and throttled progress.

These go beyond polling: each is a Structured Streaming query over a file source with a
checkpoint, so a batch that was written is not written again after a failure."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files: str = "*.parquet", schema: str = SCHEMA) -> DataFrame:
    """A stream of the event files in a folder, with ts as a timestamp."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events that arrive again within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def throttled(events: DataFrame, gap_seconds: float = 2.0) -> DataFrame:
    """Each user's events at least `gap_seconds` after the last one let through; the first always."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for row in frame.sort_values(["ts", "event_id"]).itertuples():
                t = row.ts.timestamp()
                if last is None or t - last >= gap_seconds:
                    last = t
                    out.append((key[0], row.event_id, row.ts))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts"])

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp", "last double", "append", "NoTimeout")


def run_available(stream: DataFrame, folder: str, mode: str, write: Callable[[DataFrame], None]) -> None:
    """Everything that is there now, batch by batch, then stop. folder holds the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(lambda df, _: write(df)).start()
    q.awaitTermination()


def totals_now(stream: DataFrame, folder: str) -> DataFrame:
    """The complete result of an aggregating stream over all there is."""
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    run_available(stream, folder, "complete", lambda df: df.write.mode("overwrite").parquet(path))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
