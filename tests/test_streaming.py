"""Structured Streaming jobs over files written in steps."""

import datetime as dt
import time

import pytest

from tamarack.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches as files and reads them as a stream, one file a trigger."""

    class Feed:
        def __init__(self):
            self.path, self.n = f"file://{tmp_path}/in", 0

        def put(self, rows, schema):
            self.schema = schema
            time.sleep(1.1)  # files are taken in the order of their times
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.path)

        def run(self, job, mode):
            self.n += 1
            stream = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)
            query = job(stream).writeStream.format("memory").queryName(f"out{self.n}").outputMode(mode)
            query = query.option("checkpointLocation", f"file://{tmp_path}/checkpoint{self.n}").trigger(availableNow=True).start()
            query.awaitTermination(120)
            return spark.table(f"out{self.n}").collect()

    return Feed()


def at(minute, second=0, day=1):
    return dt.datetime(2024, 1, day, 0, minute, second)


def test_minute_windows_close_behind_the_watermark(feed):
    kind = "bucket string, ts timestamp"
    feed.put([("k", at(0, s)) for s in range(5)] + [("j", at(0, 9))], kind)
    feed.put([("k", at(10))], kind)
    feed.put([("k", at(11))], kind)  # rows are late by the watermark of the batch before
    feed.put([("k", at(0, 1)), ("k", at(20))], kind)
    got = {(r.bucket, r.minute.minute): (r.n, r.rejected) for r in feed.run(lambda s: jobs.minute_counts(s, 3), "append")}
    assert got[("k", 0)] == (5, 2) and got[("j", 0)] == (1, 0)


def test_daily_budget_is_kept_in_state(feed):
    kind = "request_id bigint, bucket string, ts timestamp, tokens double"
    feed.put([(1, "k", at(1), 60.0), (2, "k", at(2), 60.0)], kind)
    feed.put([(3, "k", at(3), 1.0), (4, "k", at(1, day=2), 5.0)], kind)
    got = {r.request_id: (r.used_before, r.refused) for r in feed.run(lambda s: jobs.admitted(s, 100), "append")}
    assert got == {1: (0.0, False), 2: (60.0, False), 3: (120.0, True), 4: (0.0, False)}


def test_files_seen_before_are_left_out(feed):
    kind = "path string, hash string"
    feed.put([("a", "1"), ("b", "1")], kind)
    feed.put([("a", "1"), ("a", "2")], kind)
    assert sorted((r.path, r.hash) for r in feed.run(jobs.new_files, "append")) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_cache_entries_follow_the_latest_write(feed):
    kind = "key string, value string, at timestamp"
    feed.put([("k", "old", at(1)), ("k", "new", at(2))], kind)
    feed.put([("k", "stale", at(0)), ("j", "x", at(3))], kind)
    got = sorted((r.key, r.value) for r in feed.run(jobs.expiring_cache, "append"))
    assert got == [("j", "x"), ("k", "new")]


def test_batches_are_written_by_number(spark, feed, tmp_path):
    feed.put([("a", "1")], "path string, hash string")
    feed.put([("b", "1")], "path string, hash string")
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(feed.path)
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={number}")
    jobs.commit_batches(stream, write, f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.batch, r.path) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) in ([(0, "a"), (1, "b")], [(0, "b"), (1, "a")])
