"""Sampling, pairing, evidence checks, ingestion and file round trips."""

import datetime as dt
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tamarack.functions import metadata, text
from tamarack.operators import cache, dataset, ingest
from tamarack.plans import sql_guard
from tamarack.sources import readers, writers


def test_a_sample_goes_round_the_strata(spark):
    rows = [(i, "big", f"s{i % 2}") for i in range(7)] + [(7, "one", "s3"), (8, "two", "s4")]
    frame = spark.createDataFrame(rows, "id int, stratum string, source string")
    got = dataset.stratified_sample(frame, ["stratum"], "source", "id", 3).collect()
    assert {r.stratum for r in got} == {"big", "one", "two"} and len({r.source for r in got}) == 3
    again = dataset.stratified_sample(frame.repartition(5), ["stratum"], "source", "id", 6).collect()
    assert sorted(map(str, again)) == sorted(map(str, dataset.stratified_sample(frame.coalesce(1), ["stratum"], "source", "id", 6).collect()))
    assert sorted(r.source for r in again if r.stratum == "big") == ["s0", "s0", "s1", "s1"]


def test_only_neighbouring_pages_pair(spark):
    rows = [("a", 1, "c1"), ("a", 2, "c2"), ("a", 5, "c3"), ("a", None, "c4"), ("b", 2, "c5"), ("b", 2, "c6")]
    got = {(r.a, r.b) for r in dataset.adjacent_pairs(spark.createDataFrame(rows, "source_file string, page int, chunk_id string")).collect()}
    assert got == {("c1", "c2"), ("c5", "c6")}


def test_a_changed_number_is_unsupported(spark):
    kind = "case_id int, question string, answer string, scope string, chunks array<string>, evidence array<struct<chunk_index:int, quote:string>>"
    chunks = ["Revenue was 1,100 million in 2023.", "Profit rose by 5%."]
    good = [(1, "Revenue was 1 100 million"), (2, "profit  rose by")]
    rows = [
        (1, "What was revenue?", "1100 and 5%", "multi_chunk", chunks, good), (2, "What was revenue?", "200 million", "multi_chunk", chunks, good),
        (3, "What?", "x", "multi_chunk", chunks, []), (4, "What was revenue?", "in 2023", "single_chunk", chunks, [(3, "something"), (1, "abc"), (2, "not in there")]),
    ]
    got = {r.case_id: (r.accepted, r.reasons) for r in dataset.validate_pairs(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, ["unsupported_answer_numbers:200"])
    assert got[3] == (False, ["question_too_short", "answer_too_short", "missing_evidence_quotes", "multi_chunk_evidence_incomplete"])
    assert got[4] == (False, ["invalid_evidence_chunk_index", "evidence_too_short", "evidence_quote_not_found"])


def test_bundles_are_written_once(spark, tmp_path):
    kind = "case_id string, answerable boolean, reasoning_scope string, content_types array<string>, review_status string"
    rows = spark.createDataFrame([(f"c{i}", i != 4, "multi_chunk" if i % 2 else "single_chunk", ["table"] if i < 3 else ["text"], "pending") for i in range(10)], kind)
    path = f"file://{tmp_path}/bundle"
    writers.write_bundle(rows, path, ["reasoning_scope"], 3, 6)
    assert [spark.read.json(f"{path}/{n}").count() for n in ("full", "smoke", "regression")] == [10, 3, 6]
    counts = spark.read.json(f"{path}/manifest").first()
    assert (counts.records, counts.no_answer, counts.pending_review, counts.table_cases, counts.multi_chunk) == (10, 1, 10, 3, 5)
    with pytest.raises(AnalysisException):
        writers.write_bundle(rows, path, ["reasoning_scope"], 3, 6)


def test_store_versions(spark, tmp_path):
    store = writers.ChunkStore(spark, f"file://{tmp_path}/store", "chunk_id string, content string, n int")
    assert store.version() == 0 and store.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, content string, n int")
    assert store.upsert(rows(("a", "1", 1), ("b", "1", 1))) == 1
    assert store.upsert(rows(("b", "2", 1), ("b", "3", 2), ("c", "1", 1)), seq="n") == 2
    assert {(r.chunk_id, r.content) for r in store.read().collect()} == {("a", "1"), ("b", "3"), ("c", "1")}
    assert {(r.chunk_id, r.content) for r in store.read(1).collect()} == {("a", "1"), ("b", "1")}


def test_insert_or_ignore_takes_the_first(spark):
    kind = "company string, year string, v int"
    old = spark.createDataFrame([("a", "2023", 1)], kind)
    new = spark.createDataFrame([("a", "2023", 5), ("b", "2023", 7), ("b", "2023", 6)], kind)
    assert [tuple(r) for r in ingest.insert_or_ignore(old, new, ["company", "year"], ["v"]).select("company", "year", "v").collect()] == [("b", "2023", 6)]


def test_files_are_found_and_diffed(spark, tmp_path):
    for name, body in (("tech/a.TXT", "alpha"), ("tech/b.md", "beta"), ("c.csv", "h,k\n1,\n,\n2,x\n"), ("skip.bin", "no"), ("top.py", "x = 1")):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    files = readers.discover(spark, f"{tmp_path}/in")
    got = {r.source_file: (r.parser, r.industry) for r in files.collect()}
    assert got == {"tech/a.TXT": ("basic", "tech"), "tech/b.md": ("basic", "tech"), "c.csv": ("table", None), "top.py": ("basic", None)}
    manifest = files.select("path", F.when(F.col("source_file") == "c.csv", "old").otherwise(F.col("hash")).alias("hash")).where("source_file <> 'top.py'")
    assert {r.source_file for r in ingest.changed_files(files, manifest).collect()} == {"c.csv", "top.py"}
    assert [(r.row_number, r.content) for r in readers.read_rows(spark, f"{tmp_path}/in/c.csv").orderBy("row_number").collect()] == [(2, "h：1"), (4, "h：2；k：x")]
    assert {r.text for r in readers.read_texts(spark, f"{tmp_path}/in/tech").collect()} == {"alpha", "beta"}


def test_batches_of_chunks(spark):
    rows = spark.createDataFrame([(f, i) for f in "abc" for i in range(4)], "file string, i int")
    got = ingest.batch_cut(rows, 5, "file", ["file", "i"]).collect()
    assert {(r.file, r.done_batch) for r in got} == {("a", 0), ("b", 1), ("c", 2)} and [sum(r.batch == b for r in got) for b in range(3)] == [5, 5, 2]


def test_pieces_keep_every_word():
    rng = random.Random(8)
    for _ in range(30):
        body = "".join(rng.choice(["word", "x" * 30, " ", " ", "\n", "\n\n", "é"]) for _ in range(rng.randrange(0, 200)))
        pieces = ingest.split_pieces(body, 60, 12)
        assert all(0 < len(p) <= 60 for p in pieces)
        assert set("".join(body.split())) <= set("".join(pieces)) | set()
        assert sum(len("".join(p.split())) for p in pieces) >= len("".join(body.split()))
    assert ingest.split_pieces("", 60, 12) == []


def test_routes_and_quality(spark):
    kind = "f string, bytes_per_page double, text_chars_per_page double, image_area_ratio double, table_like_pages_ratio double, multi_column_pages_ratio double"
    rows = spark.createDataFrame([("plain", 1.0, 900.0, 0.0, 0.0, 0.0), ("scan", 1.0, 5.0, 0.9, 0.0, 0.0), ("tables", 1.0, 900.0, 0.0, 0.5, 0.6)], kind)
    got = {r.f: (r.parser, r.ocr, r.reasons) for r in ingest.route(rows, 50_000, 40, 0.4, 0.35, 0.5).collect()}
    assert got == {"plain": ("local", "disabled", []), "scan": ("remote", "force", ["little_text", "large_images"]), "tables": ("remote", "auto", ["numeric_tables", "multiple_columns"])}
    chunks = spark.createDataFrame([("a", p, "x" * 100) for p in (1, 2, 3)] + [("b", 1, "x" * 300), ("b", None, "�" * 9)], "source_file string, page int, content string")
    files = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2)], "source_file string, pages int")
    got = {r.source_file: (r.acceptable, r.reasons) for r in ingest.parse_quality(chunks, files).collect()}
    assert got == {"a": (True, []), "b": (False, ["low_coverage", "garbled", "untraceable"]), "c": (False, ["no_content", "little_text"])}


def test_layout_of_blocks(spark):
    kind = "doc string, page int, block int, x0 double, y0 double, x1 double, y1 double, width double, height double, text string"
    rows = [("d", 1, 1, 320.0, 100.0, 560.0, 120.0, 600.0, 800.0, "right"), ("d", 1, 2, 20.0, 300.0, 240.0, 320.0, 600.0, 800.0, "left low"), ("d", 1, 3, 20.0, 100.0, 240.0, 120.0, 600.0, 800.0, "left top"), ("d", 1, 4, 20.0, 5.0, 240.0, 20.0, 600.0, 800.0, "header"), ("d", 1, 5, 20.0, 500.0, 120.0, 520.0, 600.0, 800.0, "in table")]
    blocks = spark.createDataFrame(rows, kind)
    tables = spark.createDataFrame([("d", 1, 0.0, 490.0, 80.0, 600.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    kept = ingest.reading_order(ingest.outside_tables(ingest.body_blocks(blocks), tables))
    assert [r.block for r in kept.orderBy("position").collect()] == [3, 2, 1]


def test_metadata_aliases(spark):
    rows = spark.createDataFrame([({"page": "3", "score": "0.5", "source_pages": "2,2,-1,x,7", "k": "v"},), ({"source_page": None, "page": "3", "source_file": " "},)], "m map<string,string>")
    got = rows.select(metadata.normalise(F.col("m")).alias("n")).select("n.*").collect()
    assert (got[0].source_page, got[0].retrieval_score, got[0].source_pages, got[0].extra) == (3, 0.5, [2, 7], {"k": "v"})
    # The older spelling stands in for an absent key, not for a null one.
    assert got[1].source_page is None and got[1].source_file is None
    assert rows.where(metadata.matches(F.col("m"), {"page": "3", "k": "v"})).count() == 1 and rows.where(metadata.matches(F.col("m"), {"source_page": "3"})).count() == 0


def test_text_helpers(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(text.trim_after(F.lit("abc def"), 4)) == "abc..." and one(text.trim_within(F.lit("abcdef"), 5)) == "ab..." and one(text.trim_within(F.lit("abc"), 5)) == "abc"
    assert one(text.token_estimate(F.lit("é1"))) == 2 and one(text.token_estimate(F.lit(None).cast("string"))) == 0
    assert one(text.clear_abstention(F.lit("无法根据资料确定。"))) == "abstention" and one(text.clear_abstention(F.lit("资料不足以确定，约 5 亿元"))) == "judge_error" and one(text.clear_abstention(F.lit(" "))) == "empty_response"
    assert one(text.research_skill(F.lit("分析 新能源行业"))) == "research_intent=分析; market_subject=行业" and one(text.research_skill(F.lit("某公司财务分析 行业"))) is None
    assert one(text.markdown_row(F.array(F.lit("a|b"), F.lit("c\nd")), F.lit(3))) == "| a\\|b | c<br>d |  |"
    assert one(text.strip_fence(F.lit("```json\n{}\n```"))) == "{}" and one(text.safe_name(F.lit(' a/b:c "d" '))) == "a_b_c_d"


def test_cache_tables(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(str(i), at(i), at(i + 1), i) for i in range(6)], "query_hash string, inserted_at timestamp, expires_at timestamp, n int")
    assert {r.n for r in cache.alive(rows, F.lit(at(3))).collect()} == {3, 4, 5}
    assert {r.n for r in cache.evict(rows, rows.where("n <> 5"), capacity=5).collect()} == {1, 2, 3, 4}
    assert {r.n for r in cache.evict(rows, rows, capacity=50).collect()} == set(range(6))
    tiers = spark.createDataFrame([(0, None), (3, 0.4), (3, 0.5)], "n int, s double").select(cache.admission(F.col("n"), F.col("s")).alias("t")).collect()
    assert [r.t for r in tiers] == ["exact", "none", "both"]


def test_streams_and_lines(spark):
    lines = ["event: token", "data: a", "data: b", "", ": ping", "", "data: {}", ""]
    frame = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream_id string, line_no int, line string")
    assert [(r.event, r.data) for r in readers.server_events(frame).orderBy("event_no").collect()] == [("token", "a\nb"), ("message", "{}")]
    audit = readers.line_audit(spark.createDataFrame([(x,) for x in ('{"a": 1}', "[1]", "{bad", " ", "null")], "value string")).first()
    assert tuple(audit) == (4, 1, 2, 1)


def test_only_queries_run(spark):
    views = {"metrics": spark.createDataFrame([("a", 1.5)], "company string, value double")}
    assert sql_guard.run(spark, "Here: ```sql\nSELECT value FROM metrics WHERE company = 'a';\n```", views).first()[0] == 1.5
    assert sql_guard.run(spark, "WITH m AS (SELECT * FROM metrics) SELECT count(*) AS n FROM m", views).first()[0] == 1
    for bad in ("DROP TABLE metrics", "INSERT INTO metrics VALUES ('b', 1)", "CREATE TABLE t AS SELECT 1", "WITH x AS (SELECT 1 AS a) INSERT INTO metrics SELECT 'a', a FROM x", "WITH x AS (SELECT 1 AS a) DELETE FROM metrics WHERE value = 1"):
        with pytest.raises(ValueError):
            sql_guard.check(spark, bad)
