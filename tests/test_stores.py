"""The persisted query cache and the vector store against plain search."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import query_cache, search, vector_store

NOW = "2024-01-01 12:00:00"
ENTRY = "query string, vector array<float>, chunk_ids array<string>, top_score double, inserted_at timestamp, expires_at timestamp"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY).withColumn("query_hash", text.query_hash(F.col("query")))


def test_lookups_are_the_plain_search(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 6))
    rows = [(f"q{i}", [float(v) for v in base[i % 12] + rng.normal(size=6) * 0.2 * (i // 12)], [str(i)], 0.9, at(8, i % 60), at(23)) for i in range(60)]
    rows += [("twin", rows[0][1], ["twin"], 0.9, at(7), at(23)), ("q5", rows[5][1], ["newer"], 0.8, at(9), at(23)), ("old", rows[3][1], ["old"], 0.9, at(1), at(11)), ("short", [1.0, 2.0], ["s"], 0.9, at(2), at(23))]
    rows += [("zero", [0.0] * 6, ["z"], 0.9, at(2), at(23)), ("odd", [float("nan")] * 6, ["n"], 0.9, at(2), at(23)), ("bare", None, ["b"], 0.9, at(2), at(23))]
    live = query_cache.complete(entries(spark, rows)).where(F.col("expires_at") > F.to_timestamp(F.lit(NOW)))
    asked = [(i, f"Q{i} " if i < 6 else f"new{i}", [float(v) for v in base[i % 12] + rng.normal(size=6) * 0.1]) for i in range(40)] + [(100, "bare", None), (101, "none", None), (102, "x", [0.0] * 6)]
    asked += [(103, "y", rows[0][1])]
    queries = spark.createDataFrame(asked, "query_id bigint, query string, embedding array<float>").withColumn("query_hash", text.query_hash(F.col("query")))
    got = {r.query_id: (r.tier, r.chunk_ids[0], round(r.similarity, 6)) for r in query_cache.lookup(queries, live, queries.where("embedding is not null").select("query_id", "embedding")).collect()}
    newest = {}
    for q, v, c, _, t, e in sorted(rows, key=lambda r: r[4]):
        if e > at(12):
            newest[q] = (t, v, c[0])
    want = {}
    for i, q, v in asked:
        name = q.strip().lower()
        if name in newest:
            want[i] = ("exact", newest[name][2], 1.0)
        elif v and any(v):
            unit = np.array(v, np.float32).astype(float)
            scored = [(-round(float(unit @ np.array(w, np.float32).astype(float) / np.linalg.norm(unit) / np.linalg.norm(np.array(w, np.float32).astype(float))), 9), t, c) for t, w, c in newest.values() if w and len(w) == 6 and np.isfinite(w).all() and any(w)]
            score, _, c = min(scored)
            if -score >= 0.92:
                want[i] = ("semantic", c, round(-score, 6))
    assert got == want and got[103][1] == "twin" and {t for t, _, _ in got.values()} == {"exact", "semantic"}


def test_a_search_fills_and_reads_the_cache(spark, tmp_path):
    vectors = {"alpha": [1.0, 0.0], "alfa": [0.99, 0.1], "omega": [0.0, 1.0]}
    chunks = spark.createDataFrame([("1", "first", "f"), ("2", "second", "f")], "chunk_id string, content string, source_file string").withColumn("meta", F.create_map(F.lit("k"), F.lit("v")))
    asked = lambda *names: spark.createDataFrame([(i, n, 5, None) for i, n in enumerate(names)], "query_id bigint, query string, top_k int, mode string")
    known = spark.createDataFrame(list(vectors.items()), "query string, embedding array<float>")
    embed = lambda queries: queries.join(known, "query")
    calls = []

    def source(wanted):
        calls.append(sorted(r.query for r in wanted.collect()))
        return wanted.select("query_id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("chunk_id"), F.lit(1).alias("rank")).where("query_id >= 0")

    score = lambda queries, contents: pd.Series([0.9] * len(queries))
    cache = query_cache.QueryCache(spark, f"file://{tmp_path}/cache", capacity=10)
    run = lambda *names, now=NOW, **options: search.search(asked(*names), chunks, {"vector": source}, score, now=now, store=cache, **options)
    first = run("alpha", "omega", embed=embed)
    assert first.hits.count() == 0 and cache.store.read().count() == 2
    second = run(" ALPHA", "alfa", "unknown", embed=embed)
    assert {r.query_id: r.tier for r in second.hits.collect()} == {0: "exact", 1: "semantic"}
    assert calls[-1] == ["unknown"] and {(r.query_id, r.chunk_id) for r in second.results.collect()} == {(q, c) for q in (0, 1, 2) for c in "12"}
    assert cache.store.read().where("query = 'unknown'").first().vector is None  # no embedding: its hash alone

    def broken(queries):
        raise RuntimeError("the model is away")

    assert {r.query_id: r.tier for r in run("alpha", "alfa", embed=broken).hits.collect()} == {0: "exact"}
    assert run("alpha", now="2024-01-02 12:00:00").hits.count() == 0  # expired, and put in anew
    assert [r.query for r in cache.store.read().collect()] == ["alpha"]
    cache.clear()
    assert cache.store.read().count() == 0


def test_capacity_takes_the_oldest_tenths(spark, tmp_path):
    cache = query_cache.QueryCache(spark, f"file://{tmp_path}/cache", capacity=20)
    rng = random.Random(1)
    for k in range(3):
        cache.put(entries(spark, [(f"q{k}-{i}", [rng.random(), 1.0], ["c"], 0.9, at(1 + k, i), at(23)) for i in range(15)]), NOW)
    rows = cache.store.read().collect()
    tier = sorted(r.query for r in rows if r.vector is not None)
    # 15; then 30, of which 10 go; then 20 + 15, of which 16 go.
    assert len(rows) == 45 and len(tier) == 19 and tier == sorted([f"q2-{i}" for i in range(15)] + [f"q1-{i}" for i in range(11, 15)])


def test_an_overtaken_put_keeps_both(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    cache, other = query_cache.QueryCache(spark, path), query_cache.QueryCache(spark, path)
    row = lambda name: entries(spark, [(name, None, ["c"], 0.9, at(1), at(23))])
    write = cache.store._write

    def interrupted(rows, key):
        out = write(rows, key)
        cache.store._write = write
        other.put(row("theirs"), NOW)
        return out

    cache.store._write = interrupted
    cache.put(row("mine"), NOW)
    assert {r.query for r in cache.store.read().collect()} == {"mine", "theirs"}
    with pytest.raises(Exception, match="no longer the newest"):
        cache.store.replace_all(cache.store.read(), "query_hash", expected=1)


def vectors_of(rows):
    return {i: np.array(v, np.float32).astype(float) for i, v in rows}


def plain_topk(queries, vectors, k):
    out = {}
    for q, v in queries:
        unit = np.array(v, np.float32).astype(float)
        scored = sorted((-round(float(unit @ w / np.linalg.norm(unit) / np.linalg.norm(w)), 9), i) for i, w in vectors.items() if len(w) == len(unit) and np.isfinite(w).all() and w.any())
        out[q] = [i for _, i in scored[:k]]
    return out


def ids_of(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_the_vector_store_is_exact_at_full_probe(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    kind = "vec_id bigint, embedding array<float>"
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(1_000, rows_copy := [1.0] * 8), (1_001, rows_copy)]
    odd = [(2_000, None), (2_001, [0.0] * 8), (2_002, [float("nan")] * 8), (2_003, [1.0, 2.0]), (None, [1.0] * 8)]
    store = vector_store.VectorStore(spark, f"file://{tmp_path}/v")
    with pytest.raises(ValueError, match="not trained"):
        store.read()
    store.build(spark.createDataFrame(rows + odd, kind), 9)
    asked = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)] + [(50, rows_copy), (51, [0.0] * 8), (52, [1.0, 2.0, 3.0])]
    queries = spark.createDataFrame(asked + [(None, rows_copy), (60, None)], "query_id bigint, embedding array<float>")
    usable = [(q, v) for q, v in asked if q < 51]
    assert ids_of(store.search(queries, 5, probes=9)) == plain_topk(usable, vectors_of(rows), 5)
    version = store._index()[0].version()
    changed = [(i, [float(x) for x in rng.normal(size=8)]) for i in (3, 4, 5, 900)]
    store.upsert(spark.createDataFrame(changed + [(6, None), (1_000, None)], kind))
    store.upsert(spark.createDataFrame([(3, rows[3][1])], kind))  # back to its first cell
    now = dict(rows) | dict(changed) | {3: rows[3][1]}
    del now[6], now[1_000]
    assert {r.vec_id for r in store.read().collect()} == set(now) | {2_001, 2_002, 2_003}
    assert store._index()[0].version() == version + 2
    monkeypatch.setattr(vector_store, "SHARD", 16)
    monkeypatch.setattr(vector_store, "BLOCK", 4)
    assert ids_of(store.search(queries, 5, probes=9)) == plain_topk(usable, vectors_of(now.items()), 5)


@pytest.mark.parametrize("spread", [0.5, 50.0])
def test_recall_at_the_default_probes(spark, tmp_path, spread):
    """Clusters and next to none: few probes for the one, most cells for the other, nine in ten neighbours in both."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    rows = [(i, [float(x) for x in centres[i % 200] + rng.normal(size=32) * spread]) for i in range(6_000)]
    store = vector_store.VectorStore(spark, f"file://{tmp_path}/v")
    store.build(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 64, sample=2_000)
    assert store.probes() <= 12 if spread < 1 else store.probes() > 20
    asked = [r for r in rows if r[0] % 100 == 0]
    got = ids_of(store.search(spark.createDataFrame(asked, "query_id bigint, embedding array<float>"), 10))
    want = plain_topk(asked, vectors_of(rows), 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
