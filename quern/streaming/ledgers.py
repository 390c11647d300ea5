"""Ledgers, deduplication and moving averages over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files under a folder, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, events, total in tumbling days; events later than `late` behind the newest do not count."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return days.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "events", "total")


def recent_counts(events: DataFrame, key: str, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Events of a key in sliding windows, for rate limits."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with pauses below gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def first_of(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key; keys are forgotten `late` behind the newest event."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def moving_average(events: DataFrame, key: str, alpha: float = 0.3, forget_ms: int | None = None) -> DataFrame:
    """key, average, samples after each micro-batch: alpha x new + (1 - alpha) x old, in order of ts within it.

    With forget_ms, a key's state is dropped once the watermark (an hour behind the newest event) is that far past its
    last event; None keeps it for ever.
    """

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        average, samples = state.get if state.exists else (None, 0)
        ordered = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rows = ordered["value"].to_numpy(float)
        if average is None:
            average, rows, samples = rows[0], rows[1:], 1
        n = len(rows)
        average = float(average * (1 - alpha) ** n + (alpha * (1 - alpha) ** np.arange(n - 1, -1, -1)) @ rows)
        state.update((average, samples + n))
        if forget_ms:
            last = int(ordered["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]], "average": [average], "samples": [samples + n]})

    timeout = GroupStateTimeout.EventTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    if forget_ms:
        events = events.withWatermark("ts", "1 hour")
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} string, average double, samples long", "average double, samples long", "update", timeout)


def run_to_table(stream: DataFrame, mode: str, out: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result: in update mode the last row of each of keys, in complete
    mode the last micro-batch.

    Each micro-batch is written under its number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_last"))
        rows = rows.join(F.broadcast(last)).where("_batch = _last").drop("_last")  # one row
    elif keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "_batch").alias("m")).select(*keys, "m.*")
    return rows.drop("_batch")
