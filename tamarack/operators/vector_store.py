"""A vector store with upsert by id and an inverted index over trained cells.

Centroids come from a bounded sample; every vector lies in the cell of its nearest
centroid, and a search reads the cells nearest to its query. With as many probes as
cells the search is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.retrieval import _units, nearest_rows, ranked
from tamarack.session import discard, written
from tamarack.sources.commits import CommitLog
from tamarack.sources.writers import ChunkStore

#: Vectors that centroids are trained on, at most, and rounds of training.
SAMPLE, ROUNDS = 20_000, 12
#: Share of a sample's ten nearest neighbours that the default number of probes finds, and how many of the sample ask for theirs.
RECALL, ASKING, NEIGHBOURS = 0.95, 512, 10
#: Vectors of a cell, and queries, that meet in one task, about.
SHARD, BLOCK = 16_384, 2_048
#: The cell of vectors that match nothing: null, zero, not finite, or of another size.
NOWHERE = -1


def train(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; they begin at the sample's own rows, each the farthest from those before it."""
    cells = min(cells, len(vectors))
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < cells:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        length = np.linalg.norm(sums, axis=1)
        moved = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centroids)
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    return centroids


def probes_for(vectors: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """The least number of cells that hold `recall` of the nearest neighbours, within the sample, of its first ASKING vectors.

    A whole table's neighbours are nearer than a sample's, so that more of them lie in as many cells.
    """
    asking = vectors[:ASKING]
    near = asking @ vectors.T
    near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    count = min(NEIGHBOURS, len(vectors) - 1)
    if count < 1:
        return len(centroids)
    best = np.argpartition(-near, count - 1, axis=1)[:, :count]
    own = np.argmax(vectors @ centroids.T, axis=1)
    place = np.argsort(np.argsort(-(asking @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell, for each vector that asks
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


class VectorStore:
    """(vec_id, embedding) under `path`; ids of any type that orders.

    Rows are placed by cell, so an upsert rewrites the cells that its vectors come
    from and go to. A vector that leaves a cell leaves a row without
    embedding there until that cell is written again. Training anew writes all cells.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.trained = CommitLog(spark, f"{self.path}/trained")
        self.key_type = key_type

    def _index(self) -> tuple[ChunkStore, np.ndarray]:
        """The newest training's cells and centroids; an error before the first."""
        state = self.trained.read(self.trained.latest())
        if not state:
            raise ValueError("the store is not trained yet")
        store = ChunkStore(self.spark, f"{self.path}/{state['folder']}/cells", f"vec_id {self.key_type}, embedding array<float>, cell int", buckets=min(256, state["cells"] + 1), place="cell")
        rows = self.spark.read.parquet(f"{self.path}/{state['folder']}/centroids").orderBy("cell").collect()  # the number of cells
        return store, np.array([r.centroid for r in rows], dtype=np.float64).reshape(len(rows), -1)

    def build(self, vectors: DataFrame, cells: int, sample: int = SAMPLE) -> None:
        """Train on at most `sample` vectors, in hash order, and place all of them; the content is replaced."""
        usable = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        _, units = _units(drawn, "vec_id")
        if not units:
            raise ValueError("no vector to train on")
        seen = max(units.values(), key=lambda found: len(found[0]))[1]  # the commonest size is the store's
        seen = seen[np.random.default_rng(0).permutation(len(seen))]
        centroids = train(seen, cells)
        folder = uuid.uuid4().hex
        kept = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        kept.coalesce(1).write.parquet(f"{self.path}/{folder}/centroids")
        schema = f"vec_id {self.key_type}, embedding array<float>, cell int"
        store = ChunkStore(self.spark, f"{self.path}/{folder}/cells", schema, buckets=min(256, len(centroids) + 1), place="cell")
        store.replace_all(self._placed(usable, centroids, 1, "vec_id"), "vec_id")
        while not self.trained.commit(self.trained.latest() + 1, {"folder": folder, "cells": len(centroids), "probes": probes_for(seen, centroids)}):
            pass  # the last training holds

    def _placed(self, rows: DataFrame, centroids: np.ndarray, probes: int, key: str) -> DataFrame:
        """key, embedding, cell: a row for each of the nearest `probes` cells; NOWHERE for what matches nothing."""
        shared = self.spark.sparkContext.broadcast(centroids)  # cells times components

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                numbered = pa.table([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["n", "embedding"])
                _, units = _units(numbered, "n")
                rows, unit = units.get(known.shape[1], (np.empty(0, int), np.empty((0, known.shape[1]))))
                count = min(probes, len(known))
                best = np.argsort(-np.round(unit @ known.T, 9), axis=1, kind="stable")[:, :count]
                lost = np.setdiff1d(np.arange(batch.num_rows), rows)
                own = np.concatenate([np.repeat(rows, count), lost])
                cells = np.concatenate([best.ravel(), np.full(len(lost), NOWHERE)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(cells)], [key, "embedding", "cell"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(place, f"{key} {kind}, embedding array<float>, cell int")

    def upsert(self, vectors: DataFrame) -> int:
        """Vectors replace those of their ids; the ids must not repeat. A null embedding deletes."""
        store, centroids = self._index()
        fresh = written(self._placed(vectors.where("vec_id is not null"), centroids, 1, "vec_id"), "vectors")
        ids = fresh.select("vec_id", F.col("cell").alias("to"))
        moved = store.read().where("embedding is not null").select("vec_id", "cell").join(ids, "vec_id").where("cell <> to")
        rows = fresh.unionByName(moved.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "cell"))
        try:
            return store.upsert(rows, "vec_id")
        finally:
            discard([fresh])

    def read(self) -> DataFrame:
        return self._index()[0].read().where("embedding is not null").select("vec_id", "embedding")

    def probes(self) -> int:
        """Cells that a search reads for each query by default, as measured when the store was trained."""
        return self.trained.read(self.trained.latest())["probes"]

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, embedding) -> query_id, vec_id, score, rank by cosine among the vectors of the nearest `probes` cells.

        As many probes as cells give the exact result; without a number, :meth:`probes` holds: few
        in tables with clusters, most cells where vectors lie evenly.

        A cell meets its queries in shards of about SHARD vectors and blocks of about
        BLOCK queries, so a cell that holds very many vectors, or is asked for by very many queries, is many tasks' work.
        """
        store, centroids = self._index()
        asked = written(self._placed(queries.where("query_id is not null and embedding is not null"), centroids, probes or self.probes(), "query_id").where(F.col("cell") != NOWHERE), "probes")
        held = store.read().where((F.col("cell") != NOWHERE) & F.col("embedding").isNotNull())
        # One row for each cell.
        sizes = held.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
        grid = sizes.select("cell", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        grid = F.broadcast(written(grid, "grid"))
        deal = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(grid, "cell").select("query_id", "embedding", "cell", deal("query_id", "blocks").alias("block"), every("shards").alias("shard"))
        right = held.join(grid, "cell").select("vec_id", "embedding", "cell", deal("vec_id", "shards").alias("shard"), every("blocks").alias("block"))
        kinds = ", ".join(f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((asked, "query_id"), (held, "vec_id")))
        keys = ["cell", "shard", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest_rows(k), f"{kinds}, score double")
        return ranked(found, k, ties="vec_id")
