"""Small functions that no query calls: workbooks, records, ids, shares, keys, bounds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarack.functions import metadata, text
from tamarack.operators import build, cache, ingest, retrieval
from tamarack.sources import readers, writers


def test_workbooks_by_an_injected_parser(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"x")

    def parse(content):
        return {"one": pd.DataFrame({"h": ["v", None, " "], "k": [1, None, 2]}), "none": pd.DataFrame({"h": []})}

    rows = readers.sheets(spark, f"file://{tmp_path}/a.xlsx", parse).collect()
    assert [(r.sheet, r.row_number, r.content) for r in rows] == [("one", 2, "h：v；k：1.0"), ("one", 4, "k：2.0")]


def test_evaluation_records_drop_what_is_broken(spark, tmp_path):
    lines = ['{"schema_version": 1, "case_id": "a", "question": "long enough", "page": 3}', "{broken", '{"case_id": "b", "question": " ab "}', '{"case_id": "c", "question": "copyright notice"}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    assert [r.case_id for r in readers.eval_records(spark, f"file://{tmp_path}/r.jsonl").collect()] == ["a", "c"]
    assert [(r.case_id, r.page) for r in readers.eval_records(spark, f"file://{tmp_path}/r.jsonl", "copyright").collect()] == [("a", 3)]


def test_row_ids_fall_back(spark):
    rows = spark.createDataFrame([("c", "d", 1), ("", "d", 2), (None, None, 3), (None, "", 4)], "chunk_id string, document_id string, n int")
    assert [r.x for r in rows.select(ingest.row_id(F.col("chunk_id"), F.col("document_id"), F.col("n")).alias("x")).collect()] == ["c", "d", "chunk_3", "chunk_4"]
    digest = rows.select(retrieval.fusion_key(F.col("chunk_id"), F.col("document_id"), F.lit("body")).alias("x")).collect()
    assert [r.x[:8] for r in digest] == ["c", "d", "230d8358", "230d8358"]


def test_processed_rows_are_inserted_or_replaced(spark, tmp_path):
    store = writers.ChunkStore(spark, f"file://{tmp_path}/s", "id string, v int")
    writers.insert_processed(store, spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), "id")
    writers.insert_processed(store, spark.createDataFrame([("b", 3)], "id string, v int"), "id")
    assert {r.id: r.v for r in store.read().collect()} == {"a": 1, "b": 3}


def test_shares_bounds_and_suffixes(spark):
    rows = spark.createDataFrame([("信息ab", "7"), ("", None), (None, "x"), ("　一 a", "500"), ("abc", "-3")], "t string, n string")
    got = rows.select(text.cjk_share(F.col("t")).alias("share"), metadata.clamp(F.col("n"), 1, 100, 20).alias("n"), readers.page_bounds(F.col("n"), F.col("n").try_cast("int"))[1].alias("offset")).collect()
    assert [r.n for r in got] == [7, 20, 20, 100, 1] and [r.offset for r in got] == [7, 0, 0, 500, 0]
    assert got[0].share == pytest.approx(0.5) and got[4].share == 0 and 0 < got[3].share < 1 and got[1].share in (None, 0)
    assert readers.supported("a\\b.PDF") and readers.supported("x.txt") and not readers.supported("x.bin") and not readers.supported("none")
    assert build.supported_suffixes() == sorted(build.supported_suffixes()) and "pdf" in build.supported_suffixes()


def test_what_a_cache_passes_by(spark):
    rows = spark.createDataFrame([(False, None, None, False), (True, False, "hybrid", False), (None, True, None, None), (None, None, "bm25", None), (None, None, "hybrid", True)], "f boolean, s boolean, m string, e boolean")
    assert [r.x for r in rows.select(cache.bypasses(*(F.col(c) for c in "fsme")).alias("x")).collect()] == [False, True, True, True, True]
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([1.0, None],), ([1.0, float("nan")],)], "v array<double>")
    assert [r.x for r in vectors.select(cache.valid_vector(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False]
