"""Search, ingestion and evaluation in one call, stores, readers, and what a model is shown."""

import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import build, cache, context, evaluate, ingest, retrieval, search
from tamarack.sources import commits, readers, writers
from tamarack.streaming import jobs


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first().x


def test_white_space_of_any_script(spark):
    for value in ("q\n", "　q　", "\x1cq\x85", "q", " q\t\v"):
        assert one(spark, text.strip, value) == value.strip() == "q"
    assert one(spark, text.compact, "A　1,\n2，3") == "a123"
    assert one(spark, text.clear_abstention, "信息不足，同比增长5%") == "abstention"
    assert one(spark, text.clear_abstention, "信息不足，增长 5%") == "judge_error"


def test_search_tokens_keep_whole_expressions(spark):
    got = one(spark, text.search_tokens, "ＨＢＭ４ 2026H1 3.6TB/s 毛利率 a-b")
    assert {"hbm4", "2026h1", "3.6tb/s", "毛利", "利率", "a-b"} <= set(got)
    assert one(spark, text.search_tokens, None) == []
    docs = spark.createDataFrame([(1, "chip hbm4e here"), (2, "chip HBM4 here"), (3, "none"), (4, "none"), (5, "none")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "hbm4")], "query_id bigint, query string")
    assert [r.doc_id for r in retrieval.bm25_topk(asked, docs, 5, tokenizer=text.search_tokens).collect()] == [2]


def test_prefixes_fit_their_json(spark):
    for value in ("plain words", 'quo"te\\s and\nlines\t', "控制\x01字符", "", "\\\\\\\\"):
        whole = json.dumps(value, ensure_ascii=False)[1:-1]
        for room in (0, 1, 2, 5, 7, len(whole), 100):
            got = spark.createDataFrame([(value,)], "v string").select(text.fitting_prefix(F.col("v"), F.lit(room)).alias("x")).first().x
            want = max((value[:n] for n in range(len(value) + 1) if len(json.dumps(value[:n], ensure_ascii=False)) - 2 <= room), key=len)
            assert got == want, (value, room)


def test_vector_topk_of_any_ids_and_sizes(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [1.0, 0.0, 0.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [float("nan"), 1.0]), (None, [1.0, 0.0])], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [0.0, 0.0, 5.0]), ("z", [])], "query_id string, embedding array<double>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in retrieval.vector_topk(asked, vectors, 2).orderBy("query_id", "rank").collect()]
    assert got == [("x", "a", 1), ("x", "b", 2), ("y", "c", 1)]
    with pytest.raises(ValueError, match="too many"):
        cache.semantic_pairs(vectors, 0.5, most=2)
    assert {(r.left_id, r.right_id) for r in cache.semantic_pairs(vectors, 0.9).collect()} == {("a", "b")}


def test_a_long_chain_is_settled(spark):
    n = 60
    items = spark.createDataFrame([(i,) for i in range(n)], "vec_id bigint")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "left_id bigint, right_id bigint")
    assert {r.vec_id for r in cache.greedy_keep(items, links).where("kept").collect()} == set(range(0, n, 2))


def test_reranking_survives_a_broken_model(spark):
    rows = spark.createDataFrame([(1, k, "q", f"text {k}") for k in range(1, 8)] + [(2, 1, "q", "bad"), (2, 2, "q", "good")], "query_id int, rank int, query string, content string")

    def broken(queries: pd.Series, contents: pd.Series) -> pd.Series:
        raise RuntimeError("away")

    def partly(queries: pd.Series, contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: {"good": 0.9, "bad": None}.get(c, 0.5))

    got = [(r.query_id, r["rank"], r.score) for r in retrieval.rerank(rows, broken, 3).orderBy("query_id", "position").collect()]
    assert got == [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert [r.content for r in retrieval.rerank(rows.where("query_id = 2"), partly, 3).collect()] == ["good"]


def test_a_search_from_cache_to_projection(spark):
    chunks = spark.createDataFrame([(f"c{i}", f" text {i} " * 3, f"f{i % 2}", {"lang": "en" if i < 4 else "de"}) for i in range(8)], "chunk_id string, content string, source_file string, meta map<string,string>")
    lists = {name: spark.createDataFrame([(q, f"c{(i * step) % 8}", i + 1) for q in (1, 2, 3, 4) for i in range(6)], "query_id int, chunk_id string, rank int") for name, step in (("bm25", 1), ("vector", 3))}
    named = lambda name: lambda wanted: lists[name].join(wanted.select("query_id"), "query_id")
    asked = spark.createDataFrame([(1, " one ", 2, None, None), (2, "two", 9, "bm25", None), (3, "three", 3, None, {"lang": "de"}), (5, "five", 1, "vector", None), (6, "  ", 1, None, None)], "query_id int, query string, top_k int, mode string, filters map<string,string>")
    flat = lambda queries, contents: contents.str.len() * 0.0 + 0.6
    found = search.search(asked, chunks, {n: named(n) for n in lists}, flat, k=4, now="2024-01-01 00:00:00")
    trace = {r.query_id: r for r in found.trace.collect()}
    assert {q: t.stage for q, t in trace.items()} == {1: "dual_retrieve+rerank", 2: "bm25_retrieve+rerank", 3: "dual_retrieve+rerank", 5: "vector_retrieve_empty"}
    assert (trace[1].candidates, trace[1].returned, trace[2].returned) == (8, 2, 6)
    rows = {}
    for r in found.results.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r.chunk_id)
    assert rows[2] == [f"c{i}" for i in range(6)] and rows[1][0] == "c0" and all(int(c[1:]) >= 4 for c in rows[3])
    entries = found.entries.collect()
    assert len(entries) == 1 and entries[0].chunk_ids[:1] == ["c0"] and len(entries[0].chunk_ids) == 5
    again = search.search(asked.where("query_id = 1"), chunks, {n: named(n) for n in lists}, flat, k=4, entries=found.entries, now="2024-01-01 00:59:00")
    assert again.trace.first().stage == "semantic_cache_hit" and [r.chunk_id for r in again.results.orderBy("rank").collect()] == rows[1]

    def away(wanted):
        raise RuntimeError("away")

    degraded = search.search(asked, chunks, {"bm25": away, "vector": named("vector")}, flat, k=4)
    assert degraded.trace.first().degraded == "bm25_error"
    with pytest.raises(RuntimeError, match="no source works"):
        search.search(asked, chunks, {"bm25": away, "vector": away}, flat)


def test_an_ingestion_run_is_repeatable(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.txt").write_text("first text\n\n" + "word " * 300)
    (root / "t.csv").write_text("h,k\n1,\n,\n2,x\n")
    (root / "p.pdf").write_bytes(b"%PDF")
    (root / "long.pdf").write_bytes(b"%PDF long")
    (root / "skip.bin").write_bytes(b"1")
    store = build.chunk_store(spark, f"file://{tmp_path}/store")
    manifest = writers.Manifest(spark, f"file://{tmp_path}/manifest")
    pages = spark.createDataFrame([(f"{root}/long.pdf", 900)], "path string, pages int")

    def pdf(path, content):
        raise ValueError("broken file")

    first = build.ingest(spark, str(root), store, manifest, {"pdf": pdf}, pages)
    assert first["status"] == "completed" and (first["files_discovered"], first["files_selected"], first["files_skipped"]) == (4, 3, 1)
    assert first["skipped_files"][0]["source_file"] == "long.pdf"
    rows = {r.chunk_id: r.content for r in store.read().collect()}
    assert first["chunks_written"] == len(rows) and rows["t.csv::000000"] == "h：1" and rows["t.csv::000001"] == "h：2；k：x" and "a/x.txt::000000" in rows
    assert {r.path for r in manifest.read().collect()} == {f"{root}/a/x.txt", f"{root}/t.csv"}
    (root / "p.pdf").unlink()
    assert build.ingest(spark, str(root), store, manifest, pages=pages)["status"] == "up_to_date"
    (root / "t.csv").write_text("h,k\n5,\n")
    assert build.ingest(spark, str(root), store, manifest, pages=pages)["chunks_written"] == 1
    assert {r.chunk_id: r.content for r in store.read().where("source_file = 't.csv'").collect()} == {"t.csv::000000": "h：5"}
    (root / "b.txt").write_text("other")
    assert build.ingest(spark, str(root), store, manifest, pages=pages)["status"] == "completed"
    before = store.layout(store.version())
    (root / "t.csv").write_text("")
    (root / "a" / "x.txt").write_text(" \n ")
    emptied = build.ingest(spark, str(root), store, manifest, pages=pages)
    assert (emptied["status"], emptied["files_removed"]) == ("no_content", 1)
    assert [r.source_file for r in store.read().collect()] == ["b.txt"]
    assert sum(store.layout(store.version()).get(b) == v for b, v in before.items()) >= 1  # b.txt's bucket is left alone
    assert {r.path for r in manifest.read().collect()} == {f"{root}/a/x.txt", f"{root}/b.txt"}
    (root / "b.txt").unlink()
    assert build.ingest(spark, str(root), store, manifest, pages=pages)["status"] == "up_to_date"
    assert store.read().count() == 0
    (root / "q.pdf").write_bytes(b"%PDF")
    with pytest.raises(RuntimeError, match="broken file"):
        build.ingest(spark, str(root), store, manifest, {"pdf": pdf}, fail_fast=True)
    assert build.ingest(spark, f"{tmp_path}/gone", store, manifest)["status"] == "missing_data_dir"


def test_remote_segments_are_fetched_apart_and_again(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", 7), ("b.pdf", 2), ("none.pdf", 0)], "source_file string, pages int")
    segments = files.select("source_file", F.explode(ingest.page_segments(F.col("pages"), 3)).alias("s")).select("source_file", "s.start", "s.end")
    marks = str(tmp_path)

    def fetch(name, start, end):
        import os
        import uuid

        here = [f for f in os.listdir(marks) if f.startswith(f"{name}-{start}-")]
        open(f"{marks}/{name}-{start}-{uuid.uuid4().hex}", "w").close()
        if name == "b.pdf" or start == 4 and len(here) < 2:
            raise TimeoutError("no answer")
        return json.dumps({str(p - start + 1): f"{name} page {p}" for p in range(start, end + 1)} | {"meta": "x"})

    found = build.remote_parse(segments, fetch, 4, wait=0.0)
    found.write.parquet(f"file://{tmp_path}/out")
    found = spark.read.parquet(f"file://{tmp_path}/out")
    rows = {(r.source_file, r.page_offset): (r.body is not None, r.error, r.tries) for r in found.collect()}
    assert rows == {("a.pdf", 0): (True, None, 1), ("a.pdf", 3): (True, None, 3), ("a.pdf", 6): (True, None, 1), ("b.pdf", 0): (False, "TimeoutError: no answer", 3)}
    whole = spark.createDataFrame([("a.pdf", 0, json.dumps({str(p): f"a.pdf page {p}" for p in range(1, 8)}))], "source_file string, page_offset int, body string")
    pages = lambda frame: sorted((r.page, r.content, r.chunk_id) for r in build.remote_pages(frame).collect())
    assert pages(found.where("body is not null")) == pages(whole) and len(pages(whole)) == 7


def test_profiles_route_files_of_a_run(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name in ("plain", "scan", "broken"):
        (root / f"{name}.pdf").write_bytes(f"%PDF {name}".encode())

    def profile(path, content):
        if b"broken" in content:
            raise ValueError("no pdf")
        scan = b"scan" in content
        return {"pages": 2, "sample": [{"n_chars": 5 if scan else 900, "image_area": 0.9 if scan else 0.0, "table_like": False, "two_columns": k} for k in ([0, 0] if scan else [0, 0])]}

    store, done = build.chunk_store(spark, f"file://{tmp_path}/store"), writers.Manifest(spark, f"file://{tmp_path}/manifest")
    parsers = {f"pdf_{kind}": (lambda path, content, kind=kind: [{"content": kind, "page": 1}]) for kind in ("local", "remote")}
    assert build.ingest(spark, str(root), store, done, parsers, profile=profile)["status"] == "completed"
    assert {r.source_file: r.content for r in store.read().collect()} == {"plain.pdf": "local", "scan.pdf": "remote", "broken.pdf": "local"}
    files = spark.createDataFrame([("p", bytearray(b"%PDF plain")), ("s", bytearray(b"%PDF scan!"))], "path string, content binary")
    facts = {r.path: (r.pages, r.bytes_per_page, r.sampled_pages, r.text_chars_per_page, r.image_area_ratio) for r in build.profiled(files, profile).collect()}
    assert facts == {"p": (2, 5.0, 2, 900.0, 0.0), "s": (2, 5.0, 2, 5.0, 0.9)}


def test_a_store_rewrites_only_what_it_touches(spark, tmp_path):
    store = writers.ChunkStore(spark, f"file://{tmp_path}/s", "k string, v int", buckets=8)
    assert store.read().count() == 0
    assert store.replace_all(spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int"), "k") == 1
    assert store.upsert(spark.createDataFrame([("k3", 300)], "k string, v int"), "k") == 2
    assert {r.k: r.v for r in store.read().collect()} == {f"k{i}": i for i in range(50)} | {"k3": 300}
    assert {r.k: r.v for r in store.read(1).collect()} == {f"k{i}": i for i in range(50)}
    assert sum(held == 2 for held in store.layout(2).values()) == 1
    assert writers.migrate_once(spark.createDataFrame([("c", "x")], "chunk_id string, content string"), writers.ChunkStore(spark, f"file://{tmp_path}/m", "chunk_id string, content string"), f"file://{tmp_path}/done")
    assert not writers.migrate_once(None, store, f"file://{tmp_path}/done")
    seen = []
    writers.fan_out(spark.range(3), [lambda rows: seen.append(rows.count()), lambda rows: seen.append(rows.columns)])
    assert seen == [3, ["id"]]
    writers.write_summary(spark.createDataFrame([(1, "x")], "a int, b string"), f"file://{tmp_path}/summary")
    assert spark.read.json(f"file://{tmp_path}/summary").collect()[0].b == "x"


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    kind = "k string, v int"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), kind)
    path = f"file://{tmp_path}/s"

    class Interrupted(writers.ChunkStore):
        """Another writer commits after this one has read its base and before its own commit."""

        def _write(self, frame, key):
            out = super()._write(frame, key)
            for other in between:
                between.clear()
                writers.ChunkStore(spark, path, kind, buckets=4).upsert(other, "k")
            return out

    between = []
    store = Interrupted(spark, path, kind, buckets=4)
    store.replace_all(rows(*((f"k{i}", i) for i in range(20))), "k")
    want = {f"k{i}": i for i in range(20)}
    for n, other in enumerate(("k1", "k2", "k3", "k3")):  # other buckets, the same bucket, the same key
        between.append(rows((other, 100 + n), (f"new{n}", n)))
        assert store.upsert(rows(("k3", 200 + n), (f"own{n}", n)), "k") == 3 + 2 * n
        want |= {other: 100 + n, f"new{n}": n} | {"k3": 200 + n, f"own{n}": n}
    assert {r.k: r.v for r in store.read().collect()} == want
    between.append(rows(("late", 1)))
    store.upsert(rows(), "k", drop=("v", spark.createDataFrame([(1,), (203,)], "v int")))
    assert {r.k: r.v for r in store.read().collect()} == {k: v for k, v in want.items() if v not in (1, 203)}
    stale = store.version()
    store.upsert(rows(("after", 5)), "k")
    with pytest.raises(commits.StaleWrite):
        store.replace_all(rows(("x", 1)), "k", expected=stale)
    assert store.replace_all(rows(("x", 1)), "k", expected=store.version()) == store.version()
    assert store.vacuum(seconds=0) > 0 and [r.k for r in store.read().collect()] == ["x"]


def test_sinks_append_and_report(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, [1, 2], "long " * 40)], "id int, l array<int>, t string")
    rows.write.parquet(path)
    writers.append_same_header(rows, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="columns differ"):
        writers.append_same_header(rows.select("t", "id", "l"), path)
    writers.append_usage(rows, f"file://{tmp_path}/usage")
    writers.append_usage(rows, f"file://{tmp_path}/usage")
    assert spark.read.json(f"file://{tmp_path}/usage").count() == 2
    writers.write_detail(rows, f"{tmp_path}/detail", ["id", "l", "t", "absent"], ("t",))
    lines = "".join(p.read_text() for p in (tmp_path / "detail").glob("*.csv")).splitlines()
    line = next(x for x in lines if "[1,2]" in x)
    assert lines[0] == "﻿id,l,t,absent" and line.count("long") < 40
    bundle = f"file://{tmp_path}/bundle"
    records = spark.createDataFrame([(f"c{i}", "a", True, "single_chunk", ["text"], "pending") for i in range(9)], "case_id string, b string, answerable boolean, reasoning_scope string, content_types array<string>, review_status string")
    writers.write_bundle(records, bundle, ["b"], 2, 4)
    assert [spark.read.json(f"{bundle}/{n}").count() for n in ("full", "smoke", "regression", "manifest")] == [9, 2, 4, 1]
    with pytest.raises(PySparkException):
        writers.write_bundle(records, bundle, ["b"], 2, 4)


LISTING = [{"chunk_id": f"c{i}", "content": "x", "metadata": {"n": i}} for i in range(25)]


def listing(offset, limit):
    return LISTING[offset : offset + limit]


def test_readers_number_page_and_split(spark, tmp_path):
    for name, n in (("a", 40), ("b", 3)):
        (tmp_path / f"{name}.csv").write_text("﻿h,v.w\n" + "".join(f"{name}{i},{i}\n" for i in range(n)))
    rows = readers.read_rows(spark, str(tmp_path)).collect()
    assert {(r.path[-5], r.row_number, r.content) for r in rows} == {(n, i + 2, f"h：{n}{i}；v.w：{i}") for n, k in (("a", 40), ("b", 3)) for i in range(k)}
    (tmp_path / "l.csv").write_text('h\n"two\nlines"\nnext\n')
    got = readers.read_rows(spark, f"{tmp_path}/l.csv", lines=True).orderBy("row_number").collect()
    assert [(r.row_number, r.content) for r in got] == [(2, "h：two\nlines"), (3, "h：next")]
    spark.dataSource.register(readers.PagedChunks)
    for total in ("0", "10", "20", "25"):
        found = spark.read.format("paged_chunks").option("fetch", "tests.test_composed:listing").option("total", total).option("page", "10").load()
        assert sorted(r.chunk_id for r in found.collect()) == sorted(c["chunk_id"] for c in LISTING), total
    with pytest.raises(PySparkException, match="no parser takes"):
        spark.createDataFrame([("a.bin",)], "p string").select(ingest.required_parser(F.col("p"))).collect()
    identity = spark.createDataFrame([("/d+(x)/in/y.txt",)], "p string").select(ingest.source_identity(F.col("p"), "/d+(x)").alias("s")).first().s
    assert (identity.source_file, identity.industry) == ("in/y.txt", "in")
    kept, over = ingest.page_limit(spark.createDataFrame([("a", 3), ("b", 300), ("c", None)], "path string, pages int"))
    assert {r.path for r in kept.collect()} == {"a", "c"} and over.first().reason == "pages>200"
    assert ingest.empty_manifest(spark).count() == 0
    book = spark.createDataFrame([("b", b"x")], "path string, content binary")
    parsed = readers.parsed_files(book, lambda path, content: [{"path": path, "n": len(content)}], "path string, n int").collect()
    assert [(r.path, r.n) for r in parsed] == [("b", 1)]


def test_an_evaluation_run(spark, tmp_path):
    cases = spark.createDataFrame([(1, True), (2, True), (3, False)], "case_id int, answerable boolean")
    retrieved = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "z")], "case_id int, rank int, chunk_id string")
    gold = spark.createDataFrame([(1, "b"), (2, "a")], "case_id int, chunk_id string")
    judged = spark.createDataFrame([(1, True, "supported_answer"), (2, True, "abstention"), (3, False, "abstention")], "case_id int, answerable boolean, behavior string")
    summary = evaluate.run(cases, retrieved, gold, judged, f"file://{tmp_path}/run").first()
    assert summary.retrieval.hit_at_k == 0.5 and summary.retrieval.evaluable == 2 and summary.answers.n == 3
    assert spark.read.json(f"file://{tmp_path}/run/summary").first().k == 5
    assert spark.read.csv(f"file://{tmp_path}/run/details", header=True).count() == 3
    block = evaluate.metric_block(evaluate.rank_metrics(cases, retrieved, gold, 5), ["retrieval_label_mode"], ["hit_at_k", "mrr"], 5)
    assert {r.retrieval_label_mode: r["hit@5"] for r in block.collect()} == {"chunk_id": 0.5, "no_answer": None}
    assert [r.n for r in evaluate.distribution(cases, "answerable").collect()] == [2, 1]


def test_small_projections(spark):
    assert one(spark, text.latency, 0.25, "double") == "250 ms" and one(spark, text.latency, 12.345, "double") in ("12.35 s", "12.34 s") and one(spark, text.latency, None, "double") == "-"
    assert one(spark, text.safe_sheet, " 表 1/a__") == "表_1_a" and one(spark, text.safe_sheet, "//") == "sheet"
    row = spark.createDataFrame([(None, "f.pdf", 3)], "c string, s string, p int").select(context.sourced(F.lit("body"), F.col("s"), F.col("p")).alias("a"), context.sourced(F.lit("body"), F.col("s"), F.lit(0)).alias("b")).first()
    assert row.a == "[来源：f.pdf  第 3 页]\nbody" and row.b == "[来源：f.pdf]\nbody"
    messages = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 1, "a")], "thread string, n int, content string")
    prints = {r.thread: r.fingerprint for r in context.fingerprint(messages, ["thread"], "n", ["content"]).collect()}
    assert prints == {r.thread: r.fingerprint for r in context.fingerprint(messages.repartition(3), ["thread"], "n", ["content"]).collect()} and len(set(prints.values())) == 2
    chunk = F.struct(F.lit(" x ").alias("content"), F.create_map(F.lit("page"), F.lit("1"), F.lit("none"), F.lit(None).cast("string")).alias("metadata"), F.array(F.lit("A"), F.lit("B")).alias("headings"), F.array(F.lit("r")).alias("route_reasons"))
    made = spark.range(1).select(build.parsed_document(chunk).alias("d")).first().d
    assert made.content == "x" and made.metadata == {"page": "1", "headings": "A > B", "route_reasons": "r"}
    stages = spark.createDataFrame([(1, "bm25", 9, "b", "f", 1, "xyz"), (1, "bm25", 2, "a", "f", None, None)], "case_id int, stage string, position int, chunk_id string, source_file string, source_page int, content string")
    assert [(r.chunk_id, r["rank"], r.content_chars) for r in context.snapshots(stages).orderBy("rank").collect()] == [("a", 1, 0), ("b", 2, 3)]
    same = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), (["a"], []), (None, [])], "a array<string>, b array<string>").select(context.same_members(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in same] == [True, False, True]
    rates = build.run_metrics(spark.createDataFrame([("r", 2.0, 4, 10, 3.0), ("z", 0.0, 0, 0, 0.0)], "run string, seconds double, files int, chunks int, parse_seconds double")).orderBy("run").collect()
    assert (rates[0].chunks_per_second, rates[0].parallelism, rates[1].files_per_second) == (5.0, 1.5, 0.0)


def test_files_are_forgotten_behind_the_watermark(spark, tmp_path):
    kind = "path string, hash string, seen_at timestamp"
    spark.createDataFrame([("a", "1", None), ("a", "1", None), ("b", "1", None)], kind).withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01"))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    query = jobs.new_files(stream, "1 hour").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == 2
