"""Streams with timers: ends without a new row, restarts, final states; the metrics log."""

import datetime as dt
import time
from datetime import timedelta

import pytest

from tamarack.operators import context
from tamarack.streaming import metrics, stateful

EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


@pytest.fixture
def feed(spark, tmp_path):
    """Rows written in steps, each read by a run of its own that goes on from the checkpoint of the one before."""

    class Feed:
        def put(self, rows, schema):
            self.schema = schema
            time.sleep(1.1)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

        def run(self, job):
            stream = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            query = job(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/checkpoint")
            query = query.queryName("feed").trigger(availableNow=True).start()
            ended = query.awaitTermination(180)
            query.stop()
            assert ended
            return spark.read.parquet(f"file://{tmp_path}/out").collect()

    provider = spark.conf.get(stateful.PROVIDER)
    yield Feed()
    spark.conf.set(stateful.PROVIDER, provider)


def test_progress_ends_with_the_root_or_with_silence(feed):
    kind = "request_id string, seq int, label string, root_end boolean, at timestamp"
    job = lambda s: stateful.progress(s, timedelta(minutes=10))
    feed.put([("a", 1, "think", None, at(0)), ("a", 2, "think", False, at(0)), ("a", 3, "search", False, at(1)), ("b", 1, "think", False, at(1)), ("b", 2, None, False, at(2))], kind)
    rows = feed.run(job)
    assert sorted((r.request_id, r.kind, r.label) for r in rows) == [("a", "progress", "search"), ("a", "progress", "think"), ("b", "progress", "think")]
    # Started again: a's last label is known, its root ends; b is silent while others go on.
    feed.put([("a", 4, "search", False, at(2)), ("a", 5, "answer", True, at(3)), ("c", 1, "think", False, at(30))], kind)
    feed.put([("c", 2, "think", False, at(31))], kind)
    rows = feed.run(job)
    assert len(rows) == 6
    assert {(r.request_id, r.label, r.at) for r in rows if r.kind == "final"} == {("a", "answer", at(3))}
    assert {(r.request_id, r.label, r.at) for r in rows if r.kind == "abandoned"} == {("b", "think", at(12))}


def test_a_value_expires_without_a_new_row(feed):
    kind = "key string, value string, at timestamp"
    job = lambda s: stateful.timed_cache(s, timedelta(minutes=5))
    feed.put([("k", "v1", at(0)), ("j", "w1", at(0))], kind)
    feed.put([("k", "v2", at(3)), ("k", "late", at(2))], kind)
    feed.run(job)
    feed.put([("other", "x", at(20))], kind)
    feed.put([("other", "y", at(21))], kind)
    got = {(r.key, r.value, r.at, r.event) for r in feed.run(job)}
    assert got == {("k", "v1", at(0), "held"), ("j", "w1", at(0), "held"), ("k", "v2", at(3), "held"), ("k", "v2", at(8), "expired"), ("j", "w1", at(5), "expired"), ("other", "x", at(20), "held"), ("other", "y", at(21), "held")}


def test_back_off_is_the_batch_form(spark, feed):
    spark.conf.set(EMPTY, "false")
    kind = "thread_id int, at int, source_tokens int, status string, new_tokens int"
    rows = [(t, n, (n * 37 + t * 11) % 90, ["deferred", "accepted", "rejected"][(n + t) % 3], (n * 7) % 40) for t in range(3) for n in range(8)]
    feed.put([r for r in rows if r[1] < 4], kind)
    feed.run(stateful.compaction_due)
    feed.put([r for r in rows if r[1] >= 4], kind)
    got = {(r.thread_id, r.at): r.due for r in feed.run(stateful.compaction_due)}
    spark.conf.unset(EMPTY)
    assert got == {(r.thread_id, r.at): r.due for r in context.due(spark.createDataFrame(rows, kind)).collect()}


def test_batches_leave_their_rates(spark, feed, tmp_path):
    log = metrics.MetricsLog(spark, f"file://{tmp_path}/metrics")
    spark.streams.addListener(log)
    try:
        feed.put([(i,) for i in range(50)], "n int")
        feed.put([(i,) for i in range(7)], "n int")
        feed.run(lambda s: s.where("n >= 0"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(2)
    finally:
        spark.streams.removeListener(log)
    rows = metrics.metrics(spark, f"file://{tmp_path}/metrics").orderBy("batch").collect()
    assert [(r.query, r.batch, r.rows) for r in rows] == [("feed", 0, 50), ("feed", 1, 7)]
    assert all(r.seconds > 0 and r.rows_per_second == round(r.rows / r.seconds, 2) for r in rows)
