"""Structured Streaming over the event table and over filings: windows with late data, and the entry gate with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder; the files hold wall times without a zone, taken as UTC."""
    schema = EVENTS.replace("ts timestamp", "ts timestamp_ntz")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and type: n, value. Rows more than ``late`` behind the newest are dropped, as filings gone stale are."""
    keys = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(keys, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """A user's sessions: runs of events no more than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_sightings(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Each key once, however often and in however many batches it comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def greedy_gate(filings: DataFrame, days: int = 30) -> DataFrame:
    """The anchor-greedy dedup over a stream of (key, filed date): state is the key's last kept date. Within a batch dates
    go in order; a date before the state is a duplicate, as batches cannot be taken back."""

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        kept = []
        for filed in sorted(pd.concat(list(frames))["filed"]):
            now = pd.Timestamp(filed)
            if last is None or (now - last).days > days:
                kept.append(filed)
                last = now
        if last is not None:
            state.update((last.date(),))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "filed": kept})

    return filings.groupBy("key").applyInPandasWithState(gate, "key string, filed date", "last date", "append", "NoTimeout")


def run_available(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, in append mode, and return all that has come out at ``path`` so far. State and
    offsets are kept at ``checkpoint``, so that the next run goes on; nothing passes the driver."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
