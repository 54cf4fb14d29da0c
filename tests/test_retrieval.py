"""BM25, vector search, fusion and reranking against brute force and hand-made cases."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tamarack.operators import cache, retrieval


def brute_bm25(docs, queries, k, k1=1.5, b=0.75, epsilon=None):
    terms = {i: t.lower().split() for i, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, terms.values())) / len(docs)
    df = Counter(t for ts in terms.values() for t in set(ts))
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    if epsilon is not None:
        mean = sum(idf.values()) / len(idf)
        idf = {t: epsilon * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for q, text in queries.items():
        scores = {}
        for i, ts in terms.items():
            tf = Counter(ts)
            scores[i] = round(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avgdl)) for t in text.lower().split() if tf[t]), 9)
        best = sorted(((s, i) for i, s in scores.items() if s > 0), key=lambda p: (-p[0], p[1]))[:k]
        out[q] = [(i, s) for s, i in best]
    return out


@pytest.mark.parametrize("epsilon", [None, 0.25])
def test_bm25_is_brute_force(spark, epsilon):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice(["Ash", "bay", "elm", "fir", "oak", "yew"] + [f"w{j}" for j in range(40)]) for _ in range(rng.randrange(3, 40))) for i in range(60)}
    queries = {1: "ash elm elm w3", 2: "W7 yew", 3: "absent", 4: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, query string")
    got = {q: [] for q in queries}
    for r in retrieval.bm25_topk(asked, frame, 5, epsilon=epsilon).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, pytest.approx(r.score, abs=1e-8)))
    assert got == brute_bm25(docs, queries, 5, epsilon=epsilon)


def test_bm25_without_documents_or_words(spark):
    asked = spark.createDataFrame([(1, "a")], "query_id bigint, query string")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert retrieval.bm25_topk(asked, none, 5).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert retrieval.bm25_topk(asked, blank, 5).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_vector_topk_is_brute_force(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(90)] + [(90, None), (91, [0.0] * 8)]
    vectors.append((92, vectors[5][1]))
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(4)
    asked = frame.where("vec_id % 10 = 5").withColumnRenamed("vec_id", "query_id")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v and any(v)}
    for q in range(5, 90, 10):
        best = sorted(((-round(float(unit[q] @ u), 9), i) for i, u in unit.items()))[:4]
        got = [(r.vec_id, round(r.score, 6)) for r in retrieval.vector_topk(asked, frame, 4, block).where(f"query_id = {q}").orderBy("rank").collect()]
        assert got == [(i, pytest.approx(-s, abs=1e-6)) for s, i in best]
        break
    counts = retrieval.vector_topk(asked, frame, 4, block).groupBy("query_id").count().collect()
    assert {r["count"] for r in counts} == {4} and len(counts) == 9


def test_fusion_ranks_the_shared_document_first(spark):
    lists = spark.createDataFrame([("q", 0, 1, "bm25-only"), ("q", 0, 2, "shared"), ("q", 1, 1, "shared"), ("q", 1, 2, "vector-only")], "query_id string, list_no int, rank int, key string")
    got = retrieval.reciprocal_rank_fusion(lists, 20).orderBy("rank").collect()
    assert [r.key for r in got] == ["shared", "bm25-only", "vector-only"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    alone = retrieval.reciprocal_rank_fusion(lists.where("list_no = 0"), 20).orderBy("rank").collect()
    assert [r.key for r in alone] == ["bm25-only", "shared"]
    tied = spark.createDataFrame([("q", 1, 1, "b"), ("q", 0, 1, "a")], "query_id string, list_no int, rank int, key string")
    assert [r.key for r in retrieval.reciprocal_rank_fusion(tied, 20).orderBy("rank").collect()] == ["a", "b"]


def test_rerank_is_strict_stable_and_batch_free(spark):
    rows = [("q", i, "query", f"{s}") for i, s in enumerate([0.1, 0.9, 0.5, 0.9, 0.05, 0.8], 1)]
    frame = spark.createDataFrame(rows, "query_id string, rank int, query string, content string")

    def score(queries: pd.Series, contents: pd.Series) -> pd.Series:
        return contents.astype(float)

    for batch in ("2", "100"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = retrieval.rerank(frame, score, top_n=3).orderBy("position").collect()
        assert [r["rank"] for r in got] == [2, 4, 6]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["rank"] for r in retrieval.rerank(frame, score, top_n=9).orderBy("position").collect()] == [2, 4, 6, 3]
    assert [r["rank"] for r in retrieval.rerank(frame, score, top_n=9, cap=2).collect()] == [2]


def test_filter_stays_above_the_cut(spark):
    lists = spark.createDataFrame([("q", 0, i, f"d{i}") for i in range(1, 6)], "query_id string, list_no int, rank int, key string")
    fused = retrieval.reciprocal_rank_fusion(lists, 2)
    assert retrieval.post_filter(fused, fused.key == "d3").count() == 0


def test_cache_thresholds(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.92, math.sqrt(1 - 0.92**2)]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, -1.0])], "query_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in cache.nearest(asked, entries, 0.92).collect()] == [(10, 1)]
    edge = entries.where("vec_id = 2")
    assert cache.nearest(asked, edge, 0.92).count() == 1 and cache.nearest(asked, edge, 0.93).count() == 0
