"""Near-duplicate embeddings through spherical-cap filters.

A table's filters are all pairs of one codeword from each of two random
orthogonal codes, one per half of the randomly rotated space; a vector passes a
filter when its inner product with the pair's direction exceeds the cap. Sorting
out codewords that cannot reach the cap decodes a vector to all its filters
without trying every one. Vectors that share a filter are compared in double
precision. Equal vectors are one class from the start, counted with its size.

The cap follows from the number of vectors and their size: a filter should hold
about BUCKET of them. Codewords follow from the cap, and tables are added until
simulated pairs at the threshold share a filter in RECALL of the cases, whatever
the size. Few vectors, or such of under 4 components, have one filter for all.

A pair is counted in the least filter that both pass and nowhere else, so links
are summed per class and pairs are never written out; components take a
spanning forest of each filter's links. Filters with more classes than `block`
are dealt out over a grid of block pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import drop_tables, materialize
from tamarack.llm.graph import connected_components

#: Vectors that a filter should hold, and rows of one that a task holds twice at most.
BUCKET, BLOCK = 2_000, 3_000
#: Share of simulated pairs at the threshold that share a filter, at least, and their number.
RECALL, SIMULATED = 0.98, 1_000
#: Vectors that a plan is made for where their number isn't given.
ROWS = 1_000_000
SEED = 11


def _code(rng: np.random.Generator, words: int, size: int) -> np.ndarray:
    """Codewords from random orthogonal bases and their negatives."""
    bases = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-words // (2 * size)))]
    return np.concatenate([np.concatenate([b, -b]) for b in bases])[:words]


@lru_cache(maxsize=64)
def _table(size: int, words: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and two codes, the same everywhere."""
    rng, half = np.random.default_rng([SEED, size, words, number]), size // 2
    return np.linalg.qr(rng.standard_normal((size, size)))[0], _code(rng, words, half), _code(rng, words, size - half)


@dataclass(frozen=True)
class Plan:
    """Filters for vectors of one size: `tables` of `words` x `words` directions, or one for all where there are no tables."""

    size: int
    cap: float = 0.0
    words: int = 0
    tables: int = 0

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """All filters that a unit vector passes, ascending."""
        base = self.size << 42
        if not self.tables:
            return np.array([base])
        out, reach = [], self.cap * np.sqrt(2)
        for k in range(self.tables):
            turn, left, right = _table(self.size, self.words, k)
            y = unit @ turn
            a, b = left @ y[: self.size // 2], right @ y[self.size // 2 :]
            ia, ib = np.flatnonzero(a >= reach - b.max()), np.flatnonzero(b >= reach - a.max())
            i, j = np.nonzero(a[ia][:, None] + b[ib][None, :] >= reach)
            out.append(base + (k << 36) + (ia[i].astype(np.int64) << 18) + ib[j])
        return np.sort(np.concatenate(out))


def _pairs_at(size: int, cosine: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _ in range(SIMULATED):
        x, z = rng.standard_normal((2, size))
        x /= np.linalg.norm(x)
        z -= z @ x * x
        yield x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


@lru_cache(maxsize=64)
def plan(size: int, rows: int = ROWS, least: float = 0.9, bucket: int = BUCKET) -> Plan:
    """Cap, codewords and tables for `rows` vectors of a size; the number of rows counts by powers of two."""
    rows = 1 << max(0, rows - 1).bit_length()
    if size < 4 or rows <= 4 * bucket or least <= 0:
        return Plan(size)
    # Share of the sphere over each height, from the density of one coordinate.
    height = np.linspace(-1, 1, 400_001)[1:-1]
    density = np.exp((size - 3) / 2 * np.log1p(-(height**2)))
    over = np.cumsum(density[::-1])[::-1] / density.sum()
    cap = float(height[np.searchsorted(-over, -bucket / rows)])
    # A vector that passes a filter has a partner at `least` that passes it too, with about this probability.
    inside = height[height >= cap]
    bend = np.sqrt(max(1e-9, 1 - least**2)) * np.sqrt(np.maximum(1e-12, 1 - inside**2))
    place = np.clip((cap - least * inside) / bend, -1, 1)
    both = np.interp(place, np.linspace(-1, 1, 2_001), _over(size - 1))
    share = max(1e-6, float((both * density[height >= cap]).sum() / density[height >= cap].sum()))
    words = int(min(1 << 18, max(8, np.ceil(np.sqrt(2.0 * rows / bucket / share)))))
    pairs = list(_pairs_at(size, least, np.random.default_rng([SEED, size])))
    met = np.zeros(len(pairs), bool)
    for tables in range(1, 33):
        one = Plan(size, cap, words, tables)
        last = one.size << 42 | (tables - 1) << 36
        for k in np.flatnonzero(~met):
            x, y = (f[f >= last] for f in map(one.decode, pairs[k]))
            met[k] = bool(np.intersect1d(x, y, assume_unique=True).size)
        if met.mean() >= RECALL:
            return one
    return Plan(size)


def _over(size: int) -> np.ndarray:
    """Share of a sphere over each of 2,001 heights."""
    height = np.linspace(-1, 1, 2_001)
    density = np.exp(np.maximum(0, size - 3) / 2 * np.log(np.maximum(1e-300, 1 - height**2)))
    return np.cumsum(density[::-1])[::-1] / density.sum()


def decode(unit: np.ndarray) -> np.ndarray:
    """All filters of the plan for ROWS vectors of its size that a unit vector passes."""
    return plan(len(unit)).decode(unit)


def _keyed(vectors: DataFrame) -> tuple[DataFrame, type]:
    """vec_id, key, vec (bytes; the last two null where the vector can link with nothing), and the bytes' kind."""
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind = np.float64 if double else np.float32

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for cell in batch.column(1):
                values = cell.as_py()
                whole = values and all(v is not None for v in values)
                vec = (np.array(values, dtype=kind) + kind(0)) if whole else np.zeros(0, kind)
                good = len(vec) and np.isfinite(vec).all() and vec.any()
                raw = vec.tobytes() if good else None
                vecs.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "key", "vec"])

    ids = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(scan, f"vec_id {ids}, key binary, vec binary"), kind


def _unit(raw: bytes, kind) -> np.ndarray:
    v = np.frombuffer(raw, kind).astype(np.float64)
    return v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max()


class _Bucket:
    """One filter's rows, or the rows of one cell of its grid."""

    def __init__(self, split: bool, rows: pa.Table, least: float, kind):
        self.split, self.least = split, least
        self.cid, self.n, self.own = (rows.column(c).to_numpy() for c in ("cid", "n", "own"))
        flat = np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(len(self.cid), -1).astype(np.float64)
        flat /= np.abs(flat).max(axis=1, keepdims=True)
        self.units = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        self.earlier = rows.column("earlier")

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, links of its members counted here), (class, class it is joined to)."""
        rough, near = self.units.astype(np.float32), []
        for start in range(0, len(rough), 512):  # single precision picks the pairs that are worth a double one
            a, b = np.nonzero(rough[start : start + 512] @ rough[start + 1 :].T >= self.least - 1e-3)
            a, b = a + start, b + start + 1
            kept = (a < b) & (self.own[a] != self.own[b]) if self.split else a < b  # a pair inside a block is met in that block's own cell
            near.append((a[kept], b[kept]))
        i, j = (np.concatenate(c) for c in zip(*near))
        exact = np.concatenate([np.einsum("ij,ij->i", self.units[i[k : k + 100_000]], self.units[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)] or [np.zeros(0)])
        i, j = i[exact >= self.least], j[exact >= self.least]
        none = np.zeros(0, np.int64)
        if not len(i):
            return none, none, none, none
        first = ~self._met_before(i, j)
        links = np.zeros(len(self.cid), np.int64)
        np.add.at(links, i[first], self.n[j[first]])
        np.add.at(links, j[first], self.n[i[first]])
        root = np.arange(len(self.cid))
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for a, some in zip(i[starts], np.split(j, starts[1:])):
            roots = np.unique(root[np.append(some, a)])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        moved = np.flatnonzero(root != np.arange(len(root)))
        counted = np.flatnonzero(links)
        return self.cid[counted], links[counted], self.cid[moved], self.cid[root[moved]]

    def _met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the two rows of each pair share a smaller filter too; one bit for each filter that rows share."""
        some = np.unique(np.concatenate([i, j]))
        earlier = [np.frombuffer(self.earlier[int(k)].as_py(), np.int64) for k in some]
        names, at, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        row = np.repeat(some, [len(f) for f in earlier])
        kept = times[at] > 1
        bits = np.zeros((len(self.cid), max(1, -(-int((times > 1).sum()) // 64))), np.uint64)
        spot = place[at[kept]] if len(names) else np.zeros(0, np.int64)
        np.bitwise_or.at(bits, (row[kept], spot // 64), np.uint64(1) << (spot % 64).astype(np.uint64))
        met, step = np.zeros(len(i), bool), max(1, 4_000_000 // bits.shape[1])
        for k in range(0, len(i), step):
            met[k : k + step] = (bits[i[k : k + step]] & bits[j[k : k + step]]).any(axis=1)
        return met


def near_duplicates(vectors: DataFrame, least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept; one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing and are components of their own; sizes may differ, and only
    equal sizes link. Repeated rows are separate vectors. component_id is the
    least vec_id over links; null ids count as links but name a component only alone.
    """
    keyed, kind = _keyed(vectors)
    rows = materialize(keyed, "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    width = np.dtype(kind).itemsize
    # A row for each size of vector.
    sizes = classes.groupBy((F.length("vec") / width).cast("int").alias("size")).agg(F.count("*").alias("rows")).collect()
    plans = {r["size"]: plan(r["size"], r["rows"], least, min(BUCKET, block)) for r in sizes}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [plans[len(u)].decode(u) for u in (_unit(v.as_py(), kind) for v in part.column(2))]
                lists = (f.astype(np.int64).tobytes() for f in found)
                earlier = pa.array([raw[:at] for raw in lists for at in range(0, len(raw), 8)], pa.binary())
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                numbers = pa.array(np.concatenate(found).astype(np.int64))
                yield pa.RecordBatch.from_arrays([numbers, *(part.column(k).take(take) for k in range(3)), earlier], ["filter", "cid", "n", "vec", "earlier"])

    passed = classes.select("cid", "n", "vec").mapInArrow(emit, "filter bigint, cid bigint, n bigint, vec binary, earlier binary")
    hot = passed.groupBy("filter").agg(F.count("*").alias("size")).where(F.col("size") > block)
    hot = materialize(hot.select("filter", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large-filters")
    dealt = passed.join(hot, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "n", "own", "vec", "earlier")
    cells = cells.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], None

        def done() -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(held) if held else None
            if cell is None or cell.num_rows < 2:
                return
            counted, links, a, b = _Bucket(place[1] != place[2], cell, least, kind).found()
            if len(counted) or len(a):
                nodes, to = pa.array(np.concatenate([counted, a])), pa.array(np.concatenate([counted, b]))
                yield pa.RecordBatch.from_arrays([nodes, to, pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))], ["a", "b", "links"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], axis=1)
            turns = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for start, stop in zip([0, *turns], [*turns, len(keys)]):
                if stop > start:
                    if tuple(keys[start]) != place:
                        yield from done()
                        held, place = [], tuple(keys[start])
                    held.append(batch.slice(start, stop - start))
        yield from done()

    found = materialize(cells.mapInArrow(compare, "a bigint, b bigint, links bigint"), "vector-links")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b")).select(F.col("node").alias("cid"), "root")
    placed = classes.drop("vec").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = placed.join(least_ids, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("class_links"), "component_id")
    facts = materialize(facts, "vector-classes")
    drop_tables(vectors.sparkSession, [found, hot, classes])
    met = rows.drop("vec").join(facts, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return met.select(
        "vec_id", F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
