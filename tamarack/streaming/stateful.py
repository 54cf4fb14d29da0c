"""Streams whose state has timers and a time to live: progress with a final state, an expiring cache, back-off.

State lies in RocksDB, which :func:`keep_state_in_rocksdb` sets for the session;
a stream that is started again from its checkpoint goes on with its state and timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


def _millis(at) -> int:
    stamp = pd.Timestamp(at)
    return int((stamp.tz_localize("UTC") if stamp.tz is None else stamp).timestamp() * 1000)


def _stamp(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms")


class _Timed(StatefulProcessor):
    """One deadline for each key, moved with every change."""

    def _until(self, deadline: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if deadline is not None:
            self.handle.registerTimer(deadline)

    def close(self) -> None:
        pass


class _Progress(_Timed):
    """Labels as they change, and one last row: the root's output, or that nothing came in time."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "label string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        label, at = self.last.get() if self.last.exists() else (None, 0)
        out, ended = [], False
        for row in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = max(at, _millis(row.at))
            if row.root_end:
                out.append((key[0], "final", row.label, row.at))
                label, ended = None, True
            elif row.label is not None and row.label != label:
                out.append((key[0], "progress", row.label, row.at))
                label, ended = row.label, False
            else:
                ended = False
        if ended:
            self.last.clear()
            self._until(None)
        else:
            self.last.update((label, at))
            self._until(max(at + self.patience, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "kind", "label", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        label, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"request_id": [key[0]], "kind": ["abandoned"], "label": [label], "at": [_stamp(expiredTimerInfo.getExpiryTimeInMs())]})


def progress(events: DataFrame, patience: timedelta = timedelta(minutes=10), late: str = "1 minute") -> DataFrame:
    """(request_id, seq, label, root_end, at) -> request_id, kind, label, at.

    A label that repeats the one before it gives nothing. The end of the root
    event gives the row `final` with its label and forgets the request; a request
    that is silent for `patience` gives `abandoned` with its last label, without any further row of its own.
    """
    keep_state_in_rocksdb(events.sparkSession)
    rows = events.select("request_id", "seq", "label", F.coalesce("root_end", F.lit(False)).alias("root_end"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_Progress(int(patience.total_seconds() * 1000)), outputStructType=f"request_id {events.schema['request_id'].dataType.simpleString()}, kind string, label string, at timestamp", outputMode="Append", timeMode="EventTime"
    )


class _Expiring(_Timed):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values(["at", "value"]).iloc[-1]
        at = _millis(last["at"])
        out = []
        if not self.held.exists() or at >= self.held.get()[1]:
            self.held.update((last["value"], at))
            self._until(max(at + self.ttl, timerValues.getCurrentWatermarkInMs() + 1))
            out.append((key[0], last["value"], last["at"], "held"))
        yield pd.DataFrame(out, columns=["key", "value", "at", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, at = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"key": [key[0]], "value": [value], "at": [_stamp(at + self.ttl)], "event": ["expired"]})


def timed_cache(writes: DataFrame, ttl: timedelta = timedelta(hours=1), late: str = "1 minute") -> DataFrame:
    """(key, value, at) -> key, value, at, event: `held` as the latest value of a key enters, `expired` at its end.

    A later write moves the end; an earlier one that comes late changes nothing. The
    end needs no further row of its key, only the watermark to pass it.
    """
    keep_state_in_rocksdb(writes.sparkSession)
    rows = writes.select("key", "value", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Expiring(int(ttl.total_seconds() * 1000)), outputStructType="key string, value string, at timestamp, event string", outputMode="Append", timeMode="EventTime"
    )


class _BackOff(StatefulProcessor):
    """State is the size from which a thread may be tried again; it is forgotten some time after the last attempt."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.threshold = handle.getValueState("threshold", "tokens bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        threshold = self.threshold.get()[0] if self.threshold.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            out.append((key[0], row.at, threshold is None or row.source_tokens >= threshold))
            threshold = row.source_tokens + max(1, row.new_tokens) if row.status in ("deferred", "rejected") else None
        if threshold is None:
            self.threshold.clear()
        else:
            self.threshold.update((int(threshold),))
        yield pd.DataFrame(out, columns=["thread_id", "at", "due"])

    def close(self) -> None:
        pass


def compaction_due(attempts: DataFrame, ttl: timedelta = timedelta(days=1)) -> DataFrame:
    """(thread_id, at, source_tokens, status, new_tokens) -> thread_id, at, due, as the batch form gives over all attempts; a thread untouched for `ttl` of clock time begins anew.

    The time to live is the clock's, so Spark runs batches without rows as well: with
    the trigger availableNow, switch off spark.sql.streaming.noDataMicroBatches.enabled, or the run has no end.
    """
    keep_state_in_rocksdb(attempts.sparkSession)
    return attempts.groupBy("thread_id").transformWithStateInPandas(
        statefulProcessor=_BackOff(int(ttl.total_seconds() * 1000)), outputStructType=f"thread_id {attempts.schema['thread_id'].dataType.simpleString()}, at {attempts.schema['at'].dataType.simpleString()}, due boolean", outputMode="Append", timeMode="ProcessingTime"
    )
