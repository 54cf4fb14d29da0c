"""Envelopes, payload bounds, admission, final evidence, persisted index and the smaller helpers."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import conversation, dataset, evidence, retrieval
from tamarack.sources.commits import StaleWrite


def test_envelopes_decode_either_spelling(spark):
    rows = [
        json.dumps({"ok": True, "tool": "rag", "query": "q", "data": {"results": [{"content": "c", "source_file": "f", "source_page": 2, "chunk_id": "1"}, {"content": "d", "source": "g", "page": 0}]}}),
        json.dumps({"ok": False, "tool": "rag", "error": {"code": "TIMEOUT", "message": "m"}}),
        "no json", None, "[1]",
    ]
    got = [r.e for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", evidence.decode(F.col("j")).alias("e")).orderBy("i").collect()]
    assert got[0].ok and got[0].relevant and [(r.source, r.page) for r in got[0].results] == [("f", 2), ("g", None)]
    assert (got[1].ok, got[1].error_code, got[1].relevant, got[1].results) == (False, "TIMEOUT", False, [])
    assert [(r.ok, r.error_code) for r in got[2:]] == [(False, "INVALID")] * 3


@pytest.mark.parametrize("sizes, budget, want", [([5, 100, 100], 65, [5, 30, 30]), ([5, 5], 65, [5, 5]), ([10, 10, 10], 2, [0, 0, 0]), ([0, 9], 4, [0, 4]), ([50], 7, [7]), ([1, 2, 30, 4, 50], 27, [1, 2, 10, 4, 10])])
def test_fair_share(spark, sizes, budget, want):
    rows = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate(sizes)] + [("other", 0, "y"), ("other", 1, None)], "call_id string, position int, content string")
    got = evidence.fair_share(rows, budget).orderBy("call_id", "position").collect()
    assert [r.allowed for r in got] == [*want, 1, 0]


def test_prefix_of_a_payload(spark):
    rows = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([5, 5, 500, 1])], "k string, i int, t string")
    assert [r.i for r in evidence.within_length(rows, 60, "k", "i", ["t"]).orderBy("i").collect()] == [0, 1]


def test_calls_are_admitted_in_order(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(["rag", "off", " ", None, "rag", "rag"])], "batch_id string, position int, tool string")
    got = [r.state for r in evidence.admit_calls(rows, ["off"], ["rag"], 2).orderBy("position").collect()]
    assert got == ["admitted", "disabled", "admitted", "admitted", "admitted", "no_slot"]


def test_call_and_source_summaries(spark):
    rows = spark.createDataFrame([("b", 0, "x", True, True), ("b", 1, "y", False, True), ("b", 2, "z", None, True), ("b", 3, "w", True, False)], "k string, position int, tool string, ok boolean, has_content boolean")
    assert tuple(evidence.call_summary(rows, ["k"]).first()) == ("b", 4, 2, 1, "w")
    items = spark.createDataFrame([("t", i, s, p) for i, (s, p) in enumerate([("b", 2), ("a", None), ("b", 2), ("", 1), ("b", 1)])], "t string, position int, source string, page int")
    got = [(r.source, r.page, r["rank"], r.n_sources) for r in evidence.source_summary(items, ["t"], 2).orderBy("rank").collect()]
    assert got == [("b", 2, 1, 3), ("a", None, 2, 3)]
    assert {r.source: r.pages for r in evidence.source_pages(items, ["t"]).collect()} == {"b": [1, 2], "a": [], "": [1]}


def test_final_evidence_has_no_repeats(spark):
    kind = "thread_id string, position int, chunk_id string, source string, page int"
    ledger = spark.createDataFrame([("t", 1, "a", "s", 1), ("t", 2, "b", "s", None)], kind)
    generic = spark.createDataFrame([("t", 3, "a", "s", 1), ("t", 4, "b", "s", None), ("t", 5, "b", "s", 2), ("t", 6, "b", "s", 2), ("u", 7, "a", "s", 1)], kind)
    web = spark.createDataFrame([("t", 8, "u1"), ("t", 9, "u1"), ("t", 10, "")], "thread_id string, position int, url string")
    rows = evidence.final_evidence(ledger, generic, web).orderBy("thread_id", "rank").collect()
    assert [(r.thread_id, r.kind, r.position) for r in rows] == [("t", "ledger", 1), ("t", "ledger", 2), ("t", "generic", 5), ("t", "web", 8), ("u", "generic", 7)]
    assert evidence.final_evidence(ledger, generic, web, 2).count() == 3


def test_web_results_and_metric_lines(spark):
    rows = spark.createDataFrame([([(f" t{i} " + "x" * 300 * (i == 0), f"u{i}", None if i else "c" * 900) for i in range(7)],), (None,)], "r array<struct<title:string,url:string,content:string>>")
    got = [r[0] for r in rows.select(evidence.web_results(F.col("r"))).collect()]
    assert len(got[0]) == 5 and len(got[0][0].title) == 200 and got[0][0].content.endswith("...") and len(got[0][0].content) == 800 and got[0][1].content == "" and got[1] == []
    metrics = spark.createDataFrame([("ACME", "revenue", 1.5, "bn", "2024", 1, "f.pdf", 3), ("ACME", "profit", None, None, "2024", 0, "f.pdf", None)], "company string, metric string, value double, unit string, year string, is_estimate int, source_file string, source_page int")
    assert [r.line for r in evidence.format_metric(metrics).collect()] == ["ACME revenue (2024): 1.5 bn [estimate] (f.pdf p.3)", "ACME profit (2024): -  (f.pdf)"]


def test_an_index_is_built_once_a_version(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ash elm"), (2, "elm oak yew"), (3, "fir fir"), (4, "bay")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "ash fir")], "query_id bigint, query string")
    first = retrieval.LexicalIndex(spark, f"file://{tmp_path}", "1")
    assert not first.exists()
    first.build(docs)
    first.build(docs.limit(0))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(first.topk(asked, 3), retrieval.bm25_topk(asked, docs, 3)) and first.topk(asked, 3).count() == 2
    second = retrieval.LexicalIndex(spark, f"file://{tmp_path}", "2")
    assert second.fingerprint != first.fingerprint and not second.exists()
    first.clear()
    assert not first.exists()
    first.build(docs)
    assert first.topk(asked, 3).count() == 2

    class Cleared(retrieval.CommitLog):
        """The index is cleared between a build's beginning and its save."""

        def commit(self, number, content):
            if content["folder"]:
                super().commit(number, {"folder": None})
            return super().commit(number, content)

    second.log = Cleared(spark, second.log.path)
    with pytest.raises(StaleWrite):
        second.build(docs)
    assert not second.exists()


def test_pages_and_requests(spark):
    rows = spark.range(7)
    got = retrieval.paginate(rows, ["id"], 3, 3).collect()
    assert [(r.id, r.total, r.has_more) for r in got] == [(3, 7, True), (4, 7, True), (5, 7, True)]
    assert [r.has_more for r in retrieval.paginate(rows, ["id"], 3, 6).collect()] == [False] and retrieval.paginate(rows, ["id"], 0, -5).count() == 1
    asked = spark.createDataFrame([(" q ", 99, None), ("q", None, "BM25 "), ("  ", 1, "hybrid"), ("x" * 2001, 1, None), ("q", 1, "odd"), ("q", 0, "vector")], "query string, top_k int, mode string")
    assert [tuple(r) for r in retrieval.requests(asked).collect()] == [("q", 10, "hybrid"), ("q", 5, "bm25"), ("q", 1, "vector")]


def test_stand_in_embeddings(spark):
    rows = spark.createDataFrame([("a b", "B a"), ("a", "zzz"), ("", None)], "x string, y string").select(retrieval.hash_embedding(F.col("x")).alias("x"), retrieval.hash_embedding(F.col("y")).alias("y")).collect()
    assert rows[0].x == rows[0].y and sum(v * v for v in rows[0].x) == pytest.approx(1) and rows[2].x is None and rows[2].y is None


def test_histories(spark):
    kinds = ["human", "ai", "tool", "ai", "human", "ai", "human"]
    rows = spark.createDataFrame([("t", i, k, f"{k}{i}", "steer" if i == 4 else None) for i, k in enumerate(kinds)], "thread_id string, idx int, type string, content string, name string")
    assert [r.idx for r in conversation.completed_history(rows).orderBy("idx").collect()] == [0, 3, 4, 5]
    assert conversation.without_controls(rows, ["steer"]).count() == 6
    report = conversation.context_report(rows, 30).first()
    assert (report.total_tokens, report.current_tokens, report.within) == (sum((len(f"{k}{i}") + 1) // 2 + 4 for i, k in enumerate(kinds)), 7, False)
    summaries = lambda *ids: conversation.summary_valid(rows, spark.createDataFrame([("t", list(ids))], "thread_id string, ids array<int>")).first().valid
    assert summaries(0, 1, 2, 3) and summaries(0, 1, 2, 3, 4, 5) and not summaries(0, 1) and not summaries(1, 2, 3) and not summaries(*range(9))


def test_pairs_samples_and_verdicts(spark):
    pairs = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 3, 4), ("s", 6, 7), ("s", 7, 8), ("r", 1, 2)], "source_file string, a int, b int")
    assert {tuple(r) for r in dataset.disjoint_pairs(pairs).collect()} == {("s", 1, 2), ("s", 3, 4), ("s", 6, 7), ("r", 1, 2)}
    assert dataset.seeded_sample(spark.range(5), "id", 9).count() == 5
    first, again = ({r.id for r in dataset.seeded_sample(spark.range(50).repartition(n), "id", 9, seed="s").collect()} for n in (2, 5))
    assert first == again and len(first) == 9
    checked = spark.createDataFrame([(False, ["a:1,2", "b"]), (False, ["a:3"]), (True, ["c"])], "accepted boolean, reasons array<string>")
    assert {tuple(r) for r in dataset.rejections(checked).collect()} == {("a", 2), ("b", 1)}
    records = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "case_id string, answer string")
    verdicts = spark.createDataFrame([("1", "abstention"), ("1", "abstention"), ("2", None)], "case_id string, behavior string")
    got = {r.case_id: (r.judged, r.behavior) for r in dataset.with_verdicts(records, verdicts, F.lit("judge_error")).collect()}
    assert got == {"1": (True, "abstention"), "2": (False, "judge_error"), "3": (False, "judge_error")}


def test_more_text(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(text.nfkc_tokens(F.lit("Ａb 中文字 ﬁne"))) == ["ab", "中", "文", "字", "中文", "文字", unicodedata.normalize("NFKC", "ﬁne")]
    assert one(F.size(text.nfkc_tokens(F.lit(None).cast("string")))) == 0
    assert one(text.critical_sentences(F.lit(" One. Two 2!2 Three\n 3 三。 Two 2!"), "[0-9]")) == ["Two 2!", "2 Three", "3 三。"]
    assert one(text.tool_protocol_leak(F.lit("so < tool_call >"))) and not one(text.tool_protocol_leak(F.lit("plain")))
    assert one(text.progress_name(F.lit("ra g/..x"))) == "rag..x" and one(text.money(F.lit(0.0012))) == "CNY 0.001200" and one(text.money(F.lit(1.5))) == "CNY 1.5000" and one(text.money(F.lit(None).cast("double"))) == "-"
