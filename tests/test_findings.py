"""Cases of the reviewer's findings on queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import cache, dataset, ingest, retrieval
from tamarack.plans import catalogue
from tests import oracle


def test_odd_text_of_a_null_source_agrees_with_its_sql(spark, tmp_path):
    rows = [(1, "abc", "en", None), (2, None, "de", "s"), (3, None, None, None), (4, "", "fr", "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.connect(str(tmp_path))
    assert oracle.differences(catalogue.QUERIES["odd_text"](spark, str(tmp_path)), catalogue.ORACLES["odd_text"], con) == ""


def test_odd_text_of_odd_letters_and_figures_agrees_with_its_sql(spark, tmp_path):
    rng = random.Random(17)
    signs = [*"aZ5% 月日万，,.(-%３\t\n\x0b\x1c\x85\u2028　ΣσςİıßẞÄǅ", "ΟΔΟΣ", "İZ", "信息不足", "e\u0301", "\u200b", "\ufeff", "\U0001f9d1\u200d\U0001f680", "\u1c89", "\u1c8a", "\ua7cb", "\ua7dc", "\U00010d50", "\U00010d70", "\U00010400"]
    odd = lambda: "".join(rng.choices(signs, k=rng.choice([0, 1, 3, 8, 60, 170])))
    rows = [(i, odd(), rng.choice(["en", "de", "fr", None]), odd()) for i in range(400)]
    rows += [(900, "(5%)", "en", "x-3 %"), (901, "3.5%", "de", "\t7月"), (902, "a\n5%", "en", "ΑΣ"), (903, "5 万", "en", "İ"), (None, "x", "de", None), (None, "x", "de", None), (900, "(5%)", "en", "x-3 %")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.connect(str(tmp_path))
    assert oracle.differences(catalogue.QUERIES["odd_text"](spark, str(tmp_path)), catalogue.ORACLES["odd_text"], con) == ""


@pytest.mark.parametrize("seed", [None, "7"])
def test_disjoint_neighbours_are_those_of_the_pairs(spark, monkeypatch, seed):
    rng = random.Random(5)
    rows = [(f"s{s}", rng.choice([None, *range(9)]) if s < 4 else i, i) for s in range(6) for i in range(40)]
    chunks = spark.createDataFrame(rows, "source_file string, page int, chunk_id int").repartition(3)
    pairs = [tuple(r) for r in dataset.adjacent_pairs(chunks).withColumn("at", dataset.shuffle_key("source_file", "a", "b", seed=seed or "")).orderBy(*(["at"] if seed else []), "source_file", "a", "b").drop("at").collect()]
    used, want = set(), []
    for s, a, b in pairs:
        if not used & {(s, a), (s, b)}:
            used |= {(s, a), (s, b)}
            want.append((s, a, b))
    monkeypatch.setattr(dataset, "greedy_keep", lambda *_: pytest.fail("neighbours need no rounds"))
    assert sorted(tuple(r) for r in dataset.disjoint_neighbours(chunks, seed=seed).collect()) == sorted(want)
    assert {tuple(r) for r in dataset.disjoint_neighbours(chunks, 9, seed).collect()} == set(want[:9])
    assert len(want) > 60


def test_scores_of_queries_and_documents_meet_in_shards(spark):
    """No row of a query and a document is shuffled but each shard's best; blocks, shards and parts of them don't change the result."""
    rng = random.Random(2)
    words = [f"w{j}" for j in range(12)]
    docs = spark.createDataFrame([(i % 190, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(200)], "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=5))) for q in range(9)], "query_id int, query string")
    counted = retrieval.counted_documents(docs)
    weights = retrieval._wanted(asked, ("query_id", "query"), retrieval.tokens).select("query_id", "term", (F.col("qf") * 1.0).alias("weight"))
    gain = lambda tf, dl: tf / (1 + dl)
    posts = retrieval.postings(docs, "doc_id", "text").groupBy("doc", "term").agg(F.sum("tf").alias("tf")).join(retrieval.postings(docs, "doc_id", "text").groupBy("doc").agg(F.sum("tf").alias("dl")), "doc")
    plain = posts.join(weights, "term").groupBy("query_id", F.col("doc").alias("doc_id")).agg(F.round(F.sum(F.col("weight") * F.col("tf") / (1 + F.col("dl"))), 9).alias("score"))
    want = sorted((r.query_id, r["rank"], r.doc_id) for r in retrieval.ranked(plain, 4).collect())
    for block, shard in ((1_024, 1_000_000), (2, 100)):
        got = retrieval._best_documents(weights, counted, 4, gain, block, shard)
        assert sorted((r.query_id, r["rank"], r.doc_id) for r in got.collect()) == want
    one = weights.toArrow()
    few = retrieval.best_rows(4, gain, cells=16)(one, counted.select("doc", "dl", "terms", "tfs").toArrow()).to_pylist()
    assert sorted((r["query_id"], r["doc_id"]) for r in few) == sorted((q, d) for q, _, d in want)
    df = {r.term: r.df for r in retrieval.document_frequencies(counted).collect()}
    assert df == {r.term: r.n for r in posts.groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_greedy_keep_works_its_links_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(i):
        seen.add(1)
        return i

    links = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (-1, 4), (5, 5)]  # one end is no item, one link is to itself
    frame = spark.createDataFrame(links, "left_id bigint, right_id bigint").select(counted.asNondeterministic()("left_id").alias("left_id"), "right_id")
    kept = {r.vec_id for r in cache.greedy_keep(spark.range(7).withColumnRenamed("id", "vec_id"), frame).where("kept").collect()}
    assert kept == {0, 2, 4, 5, 6} and seen.value <= len(links)


def test_all_pairs_of_any_number_over_tiles(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(vectors, "vec_id int, embedding array<float>").repartition(3)
    one = sorted(tuple(r) for r in cache.semantic_pairs(frame, 0.8, most=None).collect())
    assert one and all(a < b for a, b, _ in one) and len({r[:2] for r in one}) == len(one)
    assert sorted(tuple(r)[:2] for r in cache.semantic_pairs(frame, 0.8, tile=9, most=None).collect()) == [r[:2] for r in one]


def test_python_holds_a_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(text, "HELD_CHARS", 5)
    real = pa.array
    monkeypatch.setattr(text.pa, "array", lambda values, *kind: made.append(len(values)) or real(values, *kind))
    texts = real(["a b", None, "", "c d e f", "g", "h"])
    assert text._lists(texts, text._folded).to_pylist() == [["a", "b"], [], [], ["c", "d", "e", "f"], ["g"], ["h"]]
    assert max(made) == 4
    docs = spark.createDataFrame([(1, "x " * 900), (2, None), (3, ""), (4, "y")], "doc_id int, text string").coalesce(1)
    monkeypatch.setattr(ingest, "HELD_CHARS", 5)
    got = {(r.k, r.seq): r.content for r in ingest.split_text(docs, "doc_id", "text").collect()}
    want = {("1", i): p for i, p in enumerate(ingest.split_pieces("x " * 900, 500, 50))} | {("4", 0): "y"}
    assert got == want


def test_nearest_rows_sorts_only_what_may_be_nearest(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (80, 3)).astype(float)  # many ties
    vectors[~vectors.any(1)] = 1
    rows = pa.array(list(vectors))
    cos = np.round((vectors @ vectors.T) / np.linalg.norm(vectors, axis=1) / np.linalg.norm(vectors, axis=1)[:, None], 9)
    want = [(q, v) for q in range(80) for v in np.argsort(-cos[q], kind="stable")[:4].tolist()]
    monkeypatch.setattr(np, "argsort", lambda *_, **__: pytest.fail("no sort of all cells"))
    got = retrieval.nearest_rows(4)(pa.table({"query_id": pa.array(range(80)), "embedding": rows}), pa.table({"vec_id": pa.array(range(80)), "embedding": rows}))
    scores = {(q, v): s for q, v, s in zip(*(c.to_pylist() for c in got.columns))}
    assert len(scores) == len(want) and all(abs(scores[p] - cos[p]) < 1e-8 for p in scores)
    assert sorted(scores.values()) == pytest.approx(sorted(cos[p] for p in want), abs=1e-8)
