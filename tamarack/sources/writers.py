"""Sinks: chunk store versions, bundles, reports, usage logs."""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import trim_after
from tamarack.operators.dataset import balanced_subset, manifest
from tamarack.operators.ingest import upsert
from tamarack.session import discard, written
from tamarack.sources.commits import CommitLog, StaleWrite


#: Buckets of a chunk store, by the hash of the column that places rows; an upsert writes those that it touches.
BUCKETS = 64
#: Times that a write merges anew because another writer changed the same buckets.
ATTEMPTS = 20


class ChunkStore:
    """Versioned chunk table in buckets, which any number of jobs may write.

    A write puts the buckets that it changed into a folder of its own and then
    commits a layout of where every bucket lies, as exactly the version after
    the one it was based on. If another writer has that number, the layout is
    taken anew; buckets that both changed are merged again, others are not touched.
    Readers pin a version. `place` is the column whose hash gives a row's bucket, the
    key by default; rows of one key must agree in it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS, place: str | None = None):
        self.spark, self.path, self.schema, self.buckets, self.place = spark, path.rstrip("/"), schema, buckets, place
        self.log = CommitLog(spark, f"{self.path}/log")
        self.columns = spark.createDataFrame([], schema).columns

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return self.log.latest()

    def _layout(self, version: int) -> dict[int, list]:
        """Bucket -> [folder, version that wrote it]."""
        return {int(b): held for b, held in self.log.read(version).get("buckets", {}).items()}

    def layout(self, version: int) -> dict[int, int]:
        """The version that wrote each bucket."""
        return {b: made for b, (_, made) in self._layout(version).items()}

    def _buckets(self, places: dict[int, list]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{folder}/bucket={b}" for b, (folder, _) in sorted(places.items())))

    def read(self, version: int | None = None) -> DataFrame:
        return self._buckets(self._layout(self.version() if version is None else version))

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, key: str) -> tuple[str, list[int]]:
        """A new folder and the buckets in it."""
        folder = uuid.uuid4().hex
        placed = rows.select(*self.columns).withColumn("bucket", self._bucket(self.place or key))
        placed.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        path, files = self.log.fs(f"{self.path}/data/{folder}")
        return folder, [int(n[7:]) for n in (s.getPath().getName() for s in files.listStatus(path)) if n.startswith("bucket=")]

    def _commit(self, base: int, layout: dict[int, list]) -> bool:
        return self.log.commit(base + 1, {"buckets": {str(b): held for b, held in sorted(layout.items())}})

    def _discard(self, folder: str) -> None:
        path, files = self.log.fs(f"{self.path}/data/{folder}")
        files.delete(path, True)

    def replace_all(self, rows: DataFrame, key: str = "chunk_id", expected: int | None = None) -> int:
        """The whole content anew. With `expected`, a store whose newest version is another one refuses the write."""
        folder, made = self._write(rows, key)
        while True:
            base = self.version() if expected is None else expected
            if self._commit(base, {b: [folder, base + 1] for b in made}):
                return base + 1
            if expected is not None:
                self._discard(folder)
                raise StaleWrite(f"version {expected} is no longer the newest")

    def upsert(self, rows: DataFrame, key: str = "chunk_id", seq: str | None = None, drop: tuple[str, DataFrame] | None = None) -> int:
        """New rows replace old ones of their key; with drop (column, values), old rows of those values go too.

        Only buckets that new rows or dropped values fall into are rewritten; values
        of another column than the one that places rows may be anywhere, and rewrite all.
        """
        place = self.place or key
        mine = [written(rows.select(*self.columns, *([seq] if seq and seq not in self.columns else [])), "incoming")]
        values = None
        if drop:
            values = written(drop[1].select(drop[0]).distinct(), "dropped")
            mine.append(values)
        hit = mine[0].select(self._bucket(place))
        if drop and drop[0] == place:
            hit = hit.unionByName(values.select(self._bucket(place)))
        touched = {r.bucket for r in hit.distinct().collect()}  # the number of buckets at most
        try:
            for _ in range(ATTEMPTS):
                base = self.version()
                layout = self._layout(base)
                if drop and drop[0] != place:
                    touched |= set(layout)
                old = self._buckets({b: held for b, held in layout.items() if b in touched})
                if drop:
                    old = old.join(values, drop[0], "left_anti").select(*self.columns)
                folder, made = self._write(upsert(old, mine[0], key, seq), key)
                while True:
                    kept = {b: held for b, held in layout.items() if b not in touched}
                    if self._commit(base, kept | {b: [folder, base + 1] for b in made}):
                        return base + 1
                    base = self.version()
                    now = self._layout(base)
                    if any(now.get(b) != layout.get(b) for b in touched) or drop and drop[0] != place and set(now) != set(layout):
                        break
                    layout = now
                self._discard(folder)
        finally:
            discard(mine)
        raise StaleWrite(f"other writers changed the same buckets {ATTEMPTS} times")

    def vacuum(self, keep: int = 1, seconds: int = 3_600) -> int:
        """Delete folders that the newest `keep` versions don't use and that are older than `seconds`; how many went.

        Younger folders may belong to a write that is not committed yet.
        """
        newest = self.version()
        used = {folder for v in range(max(1, newest - keep + 1), newest + 1) for folder, _ in self._layout(v).values()}
        path, files = self.log.fs(f"{self.path}/data")
        old = [s for s in (files.listStatus(path) if files.exists(path) else []) if s.getPath().getName() not in used and s.getModificationTime() <= 1000 * (time.time() - seconds)]
        for status in old:
            files.delete(status.getPath(), True)
        return len(old)


class Manifest:
    """(path, hash) of files that are done, in a store of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = ChunkStore(spark, path, "path string, hash string", buckets=8)

    def read(self) -> DataFrame:
        return self.store.read()

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """New hashes for these paths; paths that are `gone` leave, the others stay."""
        return self.store.upsert(rows.select("path", "hash"), "path", drop=("path", gone) if gone is not None else None)


def fan_out(rows: DataFrame, writers: list) -> None:
    """One batch to several writers in turn; rows are worked out once. A writer that fails stops those after it."""
    rows = written(rows, "batch")
    for write in writers:
        write(rows)


def write_summary(rows: DataFrame, path: str) -> None:
    """One row as one JSON object in one file."""
    rows.limit(1).coalesce(1).write.mode("overwrite").json(path)


def migrate_once(source: DataFrame, store: ChunkStore, done: str) -> bool:
    """Fill a store from an older one, once: False where the mark is there already."""
    path, files = store.log.fs(done)
    if files.exists(path):
        return False
    store.replace_all(source)
    files.create(path, True).close()
    return True


def write_bundle(records: DataFrame, path: str, buckets: list[str], smoke: int, regression: int) -> None:
    """full, smoke and regression sets as JSON lines and their manifest; an existing bundle is an error."""
    parts = {"full": records, "smoke": balanced_subset(records, buckets, smoke).drop("turn"), "regression": balanced_subset(records, buckets, regression).drop("turn")}
    for name, rows in parts.items():
        rows.write.mode("errorifexists").json(f"{path}/{name}")
    manifest(records).write.mode("errorifexists").json(f"{path}/manifest")


def detail_columns(rows: DataFrame, columns: list[str], preview: tuple[str, ...] = (), n: int = 80) -> DataFrame:
    """The fixed columns of a report, nested ones as JSON, long texts as previews; absent ones are null."""
    out = []
    for name in columns:
        if name not in rows.columns:
            out.append(F.lit(None).cast("string").alias(name))
            continue
        kind = rows.schema[name].dataType.typeName()
        value = F.to_json(name) if kind in ("array", "map", "struct") else F.col(name)
        out.append((trim_after(value, n) if name in preview else value).alias(name))
    return rows.select(*out)


def write_detail(rows: DataFrame, path: str, columns: list[str], preview: tuple[str, ...] = ()) -> None:
    """CSV with a byte-order mark in the first header."""
    frame = detail_columns(rows, columns, preview)
    frame.withColumnRenamed(columns[0], "﻿" + columns[0]).write.mode("overwrite").option("header", True).csv(path)


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_same_header(rows: DataFrame, path: str) -> None:
    """Append rows to a table whose columns are the same, in the same order; else an error."""
    have = rows.sparkSession.read.parquet(path).columns
    if have != rows.columns:
        raise ValueError(f"columns differ: {have} and {rows.columns}")
    rows.write.mode("append").parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "timestamp", kind: str = "csv", now: datetime | None = None) -> str:
    """Rows as a table of files with headers; gives the folder they are in.

    timestamp: a new folder beside `path`, named by the time, never one that is
    there; overwrite: `path` anew; append: onto `path`, whose columns must be the same in the same order, or `path` made where there is none.
    """
    spark = rows.sparkSession
    options = {"header": True} if kind == "csv" else {}
    if mode == "timestamp":
        path = f"{path.rstrip('/')}_{now or datetime.now():%Y%m%d_%H%M%S}"
    elif mode == "append":
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            have = spark.read.format(kind).options(**options).load(path).columns
            if have != rows.columns:
                raise ValueError(f"columns differ: {have} and {rows.columns}")
    elif mode != "overwrite":
        raise ValueError(f"no such mode: {mode}")
    rows.write.format(kind).options(**options).mode({"timestamp": "errorifexists"}.get(mode, mode)).save(path)
    return path


def insert_processed(store: ChunkStore, rows: DataFrame, key: str) -> int:
    """Insert or replace by key."""
    return store.upsert(rows, key)
