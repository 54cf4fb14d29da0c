"""Query cache over tables: exact and nearest lookups, admission, expiry, eviction.

Entries are (query_hash, query, vector, documents, top_score, inserted_at, expires_at).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import query_hash
from tamarack.operators.retrieval import _units, vector_topk
from tamarack.session import discard, written

TTL, EMPTY_TTL = 3_600, 300
ADMIT = 0.5
CAPACITY = 2_000
#: Rows of a question set at most.
QUESTIONS = 200_000


def bypasses(filters: Column, single_source: Column, mode: Column, evaluation: Column) -> Column:
    """Searches that neither read nor fill the cache."""
    return F.coalesce(filters, F.lit(False)) | F.coalesce(single_source, F.lit(False)) | F.coalesce(evaluation, F.lit(False)) | (F.coalesce(mode, F.lit("hybrid")) != "hybrid")


def alive(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


def exact(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, query) joined to the entry of its hash."""
    return queries.withColumn("query_hash", query_hash(F.col("query"))).join(entries.drop("query"), "query_hash")


def misses(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Queries that no entry has: only these go on to the nearest lookup."""
    return queries.withColumn("query_hash", query_hash(F.col("query"))).join(entries.select("query_hash"), "query_hash", "left_anti")


def nearest(queries: DataFrame, entries: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(query_id, embedding) against (vec_id, embedding): the nearest entry at `threshold` or more, ties to the least id."""
    return vector_topk(queries, entries, 1).where(F.col("score") >= threshold).drop("rank")


def admission(n_documents: Column, top_score: Column) -> Column:
    """exact for empty results, none below ADMIT, else both."""
    return F.when(n_documents == 0, "exact").when(F.coalesce(top_score, F.lit(0.0)) < ADMIT, "none").otherwise("both")


def lifetime(n_documents: Column) -> Column:
    return F.when(n_documents == 0, EMPTY_TTL).otherwise(TTL)


def valid_vector(vector: Column, dimension: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dimension) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))


def evict(entries: DataFrame, live_hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What stays: entries without an exact twin go first; at capacity the oldest tenth goes too."""
    kept = entries.join(live_hashes.select("query_hash").distinct(), "query_hash", "left_semi")
    if kept.count() < capacity:
        return kept
    oldest = kept.orderBy("inserted_at", "query_hash").limit(max(1, capacity // 10)).select("query_hash")
    return kept.join(oldest, "query_hash", "left_anti")


def semantic_pairs(vectors: DataFrame, threshold: float, tile: int = 8_192, most: int | None = QUESTIONS) -> DataFrame:
    """(vec_id, embedding) -> left_id < right_id, score: all pairs at `threshold` or more, exactly; ids of any type that orders.

    Rows are dealt to tiles of about `tile` rows, and each pair of tiles is one
    group's matrix product, so a task holds two tiles at most. Made for question
    sets: more than `most` rows are an error, since their pairs are for the near-duplicate
    operators; None compares any number, whose pairs grow with its square.
    """
    rows = vectors.where("embedding is not null and vec_id is not null").select("vec_id", "embedding")
    count = rows.count()
    if most is not None and count > most:
        raise ValueError(f"{count} vectors are too many for all pairs; the bound is {most}")
    tiles = max(1, -(-count // tile))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "embedding")
    kind = rows.schema["vec_id"].dataType.simpleString()

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        tiles_of = [group.filter(pc.equal(group.column("own"), group.column(side)[0])) for side in ("i", "j")]
        alike = group.column("i")[0] == group.column("j")[0]
        (names, first), (others, second) = (_units(t, "vec_id") for t in tiles_of)
        schema = pa.schema([("left_id", names.type), ("right_id", others.type), ("score", pa.float64())])
        for size in first.keys() & second.keys():
            (places, matrix), (far, columns) = first[size], second[size]
            for start in range(0, len(places), 256):
                cos = matrix[start : start + 256] @ columns.T
                row, column = np.nonzero(cos >= threshold - 1e-8)
                score = np.round(cos[row, column], 9)
                good = (score >= threshold) & ((places[start + row] < far[column]) if alike else True)
                row, column, score = row[good], column[good], score[good]
                for at in range(0, len(row), 100_000):
                    part = slice(at, at + 100_000)
                    a, b = names.take(pa.array(places[start + row[part]])), others.take(pa.array(far[column[part]]))
                    turned = pc.greater(a, b)
                    yield pa.RecordBatch.from_arrays([pc.if_else(turned, b, a), pc.if_else(turned, a, b), pa.array(score[part])], schema=schema)

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare(pa.Table.from_batches(list(batches)))

    compare_all.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.groupBy("i", "j").applyInArrow(compare_all, f"left_id {kind}, right_id {kind}, score double")


def greedy_keep(items: DataFrame, links: DataFrame, key: str = "vec_id") -> DataFrame:
    """In id order, an item stays unless a kept one is linked to it: (key, kept).

    links: left_id < right_id. Each round keeps the open items without a smaller
    open neighbour, the least open one at least, and drops their neighbours, so the result is
    the sequential one, whatever the partitions and however long its chains. A chain of ascending
    ids takes a round for every second of its links. Links are worked out once; what is settled
    goes, with its links, so a round writes and shuffles what is open alone.
    """
    ids = items.select(F.col(key).alias("id"))
    inside = links.where("left_id < right_id").join(ids.withColumnRenamed("id", "left_id"), "left_id", "left_semi").join(ids.withColumnRenamed("id", "right_id"), "right_id", "left_semi")
    open_links = written(inside.select("left_id", "right_id"), "links")
    # Items without a link stay at once, and are in no round.
    ends = written(open_links.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct(), "open-items")
    settled: list[DataFrame] = []
    while ends.limit(1).count():
        least = written(ends.join(open_links.select(F.col("right_id").alias("id")), "id", "left_anti"), "kept-items")
        beaten = written(open_links.join(least.withColumnRenamed("id", "left_id"), "left_id", "left_semi").select(F.col("right_id").alias("id")).distinct(), "beaten-items")
        gone = least.unionByName(beaten)
        left = written(ends.join(gone, "id", "left_anti"), "open-items")
        fewer = open_links.join(gone.withColumnRenamed("id", "left_id"), "left_id", "left_anti").join(gone.withColumnRenamed("id", "right_id"), "right_id", "left_anti")
        fewer = written(fewer.select("left_id", "right_id"), "links")
        discard([ends, open_links, least])
        ends, open_links = left, fewer
        settled.append(beaten)
        if len(settled) == 20:  # a plan of many rounds becomes one table
            joined = written(functools.reduce(DataFrame.unionByName, settled), "beaten-items")
            discard(settled)
            settled = [joined]
    if not settled:
        return ids.select(F.col("id").alias(key), F.lit(True).alias("kept"))
    lost = functools.reduce(DataFrame.unionByName, settled).withColumn("lost", F.lit(True))
    return ids.join(lost, "id", "left").select(F.col("id").alias(key), F.col("lost").isNull().alias("kept"))
