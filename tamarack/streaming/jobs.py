"""Structured Streaming jobs over the same operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_counts(requests: DataFrame, limit: int, late: str = "61 seconds", at: str = "ts") -> DataFrame:
    """Requests and rejections of each bucket and minute; minutes close 61 seconds after the watermark passes."""
    rows = requests.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    counted = rows.groupBy(F.window("at", "1 minute"), "bucket").agg(F.count("*").alias("n"))
    return counted.select("bucket", F.col("window.start").alias("minute"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))


def daily_usage(requests: DataFrame, tokens: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    rows = requests.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    counted = rows.groupBy(F.window("at", "1 day"), "bucket").agg(F.sum(tokens).alias("used"))
    return counted.select("bucket", F.col("window.start").alias("day"), "used")


def admitted(requests: DataFrame, budget: float, at: str = "ts") -> DataFrame:
    """Each request with what its bucket's day had used before it, and whether it is refused.

    State is one running sum per bucket and day, dropped when the watermark passes the day.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (used,) = state.get if state.exists else (0.0,)
        for frame in frames:
            frame = frame.sort_values(["at", "request_id"])
            before = used + frame["tokens"].cumsum() - frame["tokens"]
            used += float(frame["tokens"].sum())
            yield pd.DataFrame({"bucket": key[0], "request_id": frame["request_id"], "used_before": before, "refused": before >= budget})
        state.update((used,))
        end = pd.Timestamp(key[1]) + pd.Timedelta(days=1)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    rows = requests.select("bucket", "request_id", F.col("tokens").cast("double").alias("tokens"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", "1 hour").withColumn("day", F.to_date("at"))
    return rows.groupBy("bucket", "day").applyInPandasWithState(
        judge, "bucket string, request_id bigint, used_before double, refused boolean", "used double", "append", GroupStateTimeout.EventTimeTimeout
    )


def new_files(files: DataFrame, late: str | None = None, at: str = "seen_at") -> DataFrame:
    """A file stream without (path, hash) pairs that were seen before.

    With `late`, pairs are remembered until the watermark on `at` has passed
    them by that time, so state shrinks again; without it they are kept for good, a row for each version of a file.
    """
    if late is None:
        return files.dropDuplicates(["path", "hash"])
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark(["path", "hash"])


def commit_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Micro-batches handed to an idempotent writer with their number: at least once, and once with it."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def expiring_cache(writes: DataFrame, ttl: timedelta = timedelta(hours=1)) -> DataFrame:
    """Latest live value of each key: (key, value, at) -> key, value, at as they enter; state goes when it expires."""
    milliseconds = int(ttl.total_seconds() * 1000)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        for frame in frames:
            last = frame.sort_values("at").iloc[-1]
            if held is None or last["at"] >= pd.Timestamp(held[1]):
                held = (last["value"], last["at"].to_pydatetime())
                yield pd.DataFrame({"key": [key[0]], "value": [held[0]], "at": [held[1]]})
        if held is not None:
            state.update(held)
            expiry = int(pd.Timestamp(held[1], tz="UTC").timestamp() * 1000) + milliseconds
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))

    rows = writes.select("key", "value", F.col("at").cast("timestamp").alias("at")).withWatermark("at", "1 minute")
    return rows.groupBy("key").applyInPandasWithState(
        keep, "key string, value string, at timestamp", "value string, at timestamp", "append", GroupStateTimeout.EventTimeTimeout
    )
