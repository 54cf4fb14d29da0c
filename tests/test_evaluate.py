"""Ranking metrics, outcomes, percentiles and audits on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evaluate

GAIN = lambda r: 1 / math.log2(r + 1)


def measured(spark, cases, retrieved, gold, k):
    return {
        r.case_id: r
        for r in evaluate.rank_metrics(
            spark.createDataFrame(cases, "case_id string, answerable boolean"),
            spark.createDataFrame(retrieved, "case_id string, rank int, chunk_id string"),
            spark.createDataFrame(gold, "case_id string, chunk_id string"),
            k,
        ).collect()
    }


def test_two_of_three_hits(spark):
    got = measured(spark, [("a", True)], [("a", 1, "g1"), ("a", 2, "noise"), ("a", 3, "g2")], [("a", "g1"), ("a", "g2")], 3)["a"]
    assert (got.retrieval_label_mode, got.hit_at_k, got.recall_at_k, got.mrr) == ("chunk_id", 1.0, 1.0, 1.0)
    assert got.precision_at_k == pytest.approx(2 / 3, abs=1e-6)
    assert got.ndcg_at_k == pytest.approx((1 + GAIN(3)) / (1 + GAIN(2)), abs=1e-6)


def test_modes_and_repeats(spark):
    cases = [("null", None), ("no", False), ("none", True), ("late", True), ("twice", True), ("silent", False)]
    retrieved = [("null", 1, "x"), ("no", 1, "x"), ("none", 1, "x"), ("late", 1, "x"), ("late", 2, "y"), ("late", 4, "g"), ("twice", 1, "g"), ("twice", 2, "g")]
    got = measured(spark, cases, retrieved, [("null", "x"), ("late", "g"), ("twice", "g"), ("no", "x")], 3)
    assert got["null"].mrr == 1.0 and got["null"].retrieval_evaluable
    assert got["no"].retrieval_label_mode == "no_answer" and got["no"].hit_at_k is None and got["no"].retrieval_abstained is False
    assert got["silent"].retrieval_abstained is True
    assert got["none"].retrieval_label_mode == "missing" and not got["none"].retrieval_evaluable
    assert (got["late"].hit_at_k, got["late"].mrr, got["late"].recall_at_k, got["late"].retrieved_count) == (0.0, 0.0, 0.0, 2)
    # A repeated gold chunk counts again in precision and gain, once in recall.
    assert got["twice"].precision_at_k == pytest.approx(2 / 3, abs=1e-6) and got["twice"].recall_at_k == 1.0 and got["twice"].ndcg_at_k > 1


def test_sources_match_by_path_suffix(spark):
    found = spark.createDataFrame(
        [("a", 1, "data/Reports\\X.pdf", 2), ("a", 2, "y.pdf", 9), ("b", 1, "report.pdf", 1), ("c", 1, "myreport.pdf", 1)], "case_id string, rank int, source_file string, source_page int"
    )
    gold = spark.createDataFrame([("a", "reports/x.pdf", 2), ("a", "y.pdf", 3), ("a", "z.pdf", None), ("b", "./docs/report.pdf", None), ("c", "report.pdf", 1), ("c", "report.pdf", 1)], "case_id string, source_file string, page int")
    got = {r.case_id: (r.gold_labels, r.matched_labels) for r in evaluate.source_page_recall(found, gold).collect()}
    assert got == {"a": (3, 1), "b": (1, 1), "c": (1, 0)}


MATRIX = {
    (True, "supported_answer"): "correct_answer", (True, "abstention"): "false_refusal", (True, "unsupported_answer"): "unsupported_answer", (True, "empty_response"): "empty_response",
    (False, "abstention"): "correct_abstention", (False, "unsupported_answer"): "hallucinated_answer", (False, "supported_answer"): "negative_label_conflict", (False, "what"): "judge_error",
    (None, " Abstention "): "false_refusal", (None, None): "judge_error",
}


def test_outcomes(spark):
    rows = spark.createDataFrame([(a, b) for a, b in MATRIX], "answerable boolean, behavior string")
    got = rows.select("answerable", "behavior", evaluate.outcome(F.col("answerable"), F.col("behavior")).alias("o")).collect()
    assert {(r.answerable, r.behavior): r.o for r in got} == MATRIX


def test_rates_of_four_records(spark):
    rows = spark.createDataFrame([(True, "supported_answer"), (True, "abstention"), (False, "abstention"), (False, "unsupported_answer")], "answerable boolean, behavior string")
    got = evaluate.answer_summary(rows).first()
    assert (got.accuracy, got.abstention_accuracy, got.hallucination_rate, got.false_refusal_rate, got.judge_coverage, got.n) == (0.5, 0.5, 0.5, 0.5, 1.0, 4)
    none = evaluate.answer_summary(rows.limit(0)).first()
    assert none.n == 0 and none.accuracy is None


def test_nearest_rank_percentiles(spark):
    rows = spark.createDataFrame([(2.5, 0.2, True), (None, 0.4, True)], "evaluation_s double, total_s double, ok boolean")
    got = evaluate.latency(rows).first()
    assert (got.p50_ms, got.p95_ms, got.ok_rate) == (400.0, 2500.0, 1.0)
    ten = spark.createDataFrame([(None, i / 1000, i > 2) for i in range(1, 11)], "evaluation_s double, total_s double, ok boolean")
    got = evaluate.latency(ten).first()
    assert (got.p50_ms, got.p95_ms, got.ok_rate) == (5.0, 10.0, 0.8)


def test_granularities(spark):
    rows = spark.createDataFrame([(True, "x", 1.0), (None, "x", 0.0), (False, "x", 1.0), (True, " ", 0.0), (True, "y", 1.0)], "answerable boolean, industry string, m double")
    got = {(r.grain, r.value): (r.n, r.m) for r in evaluate.by_granularity(rows, ["m"]).collect()}
    assert got == {("all", "all"): (5, 0.6), ("answerable", "answerable"): (4, 0.5), ("answerable", "no_answer"): (1, 1.0), ("industry", "x"): (3, 0.6667)}


def test_audit_counts(spark):
    kind = "case_id string, question string, ground_truth string, answerable boolean, schema_version int, review_status string, validation_status string, gold_chunk_ids array<string>, gold_sources array<string>, gold_evidence array<string>"
    rows = [
        ("a", "q", "t", True, 3, "approved", "passed", ["c"], None, ["e"]),
        ("a", "q", " ", None, 3, "pending", "no", None, ["s"], None),
        (None, "", None, False, 3, None, "other", None, None, None),
        ("b", "r", "t", True, 2, None, None, None, None, None),
    ]
    got = {(r.kind, r.name): r.n for r in evaluate.label_audit(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        ("issue", "review_status_pending"): 1, ("issue", "review_status_missing"): 1, ("issue", "evidence_validation_not_passed"): 1, ("issue", "missing_gold_evidence"): 1,
        ("issue", "no_answer_validation_state_invalid"): 1, ("issue", "missing_question"): 1, ("issue", "missing_reference_answer"): 1, ("issue", "missing_case_id"): 1,
        ("issue", "source_page_fallback_only"): 1, ("issue", "missing_retrieval_labels"): 1, ("issue", "duplicate_case_id"): 1, ("issue", "duplicate_question"): 1,
        ("mode", "chunk_id_labelled"): 1, ("mode", "source_page_fallback"): 1, ("mode", "no_answer_records"): 1, ("mode", "unlabelled"): 1,
        ("review", "approved"): 1, ("review", "pending"): 1, ("review", "missing"): 1,
    }
