"""A persisted cache of answered queries: by hash, then by the nearest vector.

Entries live in a bucketed store, so any job may read them and several may add.
An entry without a vector answers its own hash only; entries with one are the
semantic tier, which has a capacity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.operators.cache import CAPACITY
from tamarack.operators.retrieval import vector_topk
from tamarack.session import discard, written
from tamarack.sources.commits import StaleWrite
from tamarack.sources.writers import ATTEMPTS, ChunkStore

SCHEMA = "query_hash string, query string, vector array<float>, chunk_ids array<string>, top_score double, inserted_at timestamp, expires_at timestamp"
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
THRESHOLD = 0.92
#: (query_id, query) to query_id, embedding.
Embedder = Callable[[DataFrame], DataFrame]


def complete(entries: DataFrame) -> DataFrame:
    """Entries in the cache's columns, the newest of each hash; a missing vector column is null."""
    if "vector" not in entries.columns:
        entries = entries.withColumn("vector", F.lit(None).cast("array<float>"))
    newest = Window.partitionBy("query_hash").orderBy(F.desc("inserted_at"), F.desc("expires_at"), "query")
    return entries.select(*COLUMNS).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def embedded(queries: DataFrame, embed: Embedder | None) -> DataFrame:
    """(query_id, query) -> query_id, embedding; no rows without an embedder, or where it fails."""
    none = queries.select("query_id", F.lit(None).cast("array<float>").alias("embedding")).limit(0)
    if embed is None:
        return none
    try:
        return written(embed(queries).select("query_id", F.col("embedding").cast("array<float>").alias("embedding")), "query-vectors")
    except (PySparkException, OSError, RuntimeError, ValueError):
        return none


def _named(entries: DataFrame) -> DataFrame:
    """vec_id, embedding of the semantic tier; names are in the order of insertion, so equal scores fall to the first."""
    name = F.concat_ws("|", F.date_format("inserted_at", "yyyyMMddHHmmssSSSSSS"), "query_hash")
    return entries.where("vector is not null").select(name.alias("vec_id"), F.col("vector").alias("embedding"))


def lookup(asked: DataFrame, live: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """asked (query_id, query_hash), live entries, vectors (query_id, embedding) -> query_id, tier, entry, similarity, chunk_ids, top_score.

    The nearest lookup sees only queries whose hash no entry has. Entries whose
    vectors are of another size, zero or not finite are passed over.
    """
    facts = live.select("query_hash", "chunk_ids", "top_score")
    exact = asked.select("query_id", "query_hash").join(facts, "query_hash")
    exact = exact.select("query_id", F.lit("exact").alias("tier"), F.col("query_hash").alias("entry"), F.lit(1.0).alias("similarity"), "chunk_ids", "top_score")
    missed = vectors.join(asked.select("query_id", "query_hash").join(facts.select("query_hash"), "query_hash", "left_anti").select("query_id"), "query_id", "left_semi")
    near = vector_topk(missed, _named(live), 1).where(F.col("score") >= threshold).withColumn("query_hash", F.substring_index("vec_id", "|", -1))
    near = near.select("query_id", "query_hash", "score").join(facts, "query_hash")
    near = near.select("query_id", F.lit("semantic").alias("tier"), F.col("query_hash").alias("entry"), F.col("score").alias("similarity"), "chunk_ids", "top_score")
    return exact.unionByName(near)


class QueryCache:
    """Entries under `path`; `capacity` bounds the semantic tier, expiry the rest."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD, capacity: int = CAPACITY):
        self.spark, self.threshold, self.capacity = spark, threshold, capacity
        self.store = ChunkStore(spark, path, SCHEMA, buckets=8)

    def live(self, now: Column) -> DataFrame:
        return self.store.read().where(F.col("expires_at") > now)

    def put(self, entries: DataFrame, now: str) -> int:
        """Add entries; expired ones leave, and a semantic tier above its capacity loses its oldest tenths: these entries keep their hash alone.

        As many tenths go as bring the tier to its capacity, the new entries counted. A writer that
        was overtaken begins again with the newer content.
        """
        fresh = written(complete(entries), "cache-put")
        try:
            for _ in range(ATTEMPTS):
                version = self.store.version()
                old = self.store.read(version).where(F.col("expires_at") > F.to_timestamp(F.lit(now)))
                merged = complete(old.unionByName(fresh))
                tier = merged.where("vector is not null")
                over, tenth = tier.count() - self.capacity, max(1, self.capacity // 10)
                if over > 0:
                    oldest = tier.orderBy("inserted_at", "query_hash").limit(-(-over // tenth) * tenth).select("query_hash", F.lit(True).alias("gone"))
                    merged = merged.join(oldest, "query_hash", "left").withColumn("vector", F.when(F.col("gone").isNull(), F.col("vector")))
                try:
                    return self.store.replace_all(merged.select(*COLUMNS), "query_hash", expected=version)
                except StaleWrite:
                    continue
        finally:
            discard([fresh])
        raise StaleWrite("other writers were always faster")

    def clear(self) -> int:
        return self.store.replace_all(self.spark.createDataFrame([], SCHEMA), "query_hash")
