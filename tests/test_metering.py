"""Prices, deltas, windows and budgets on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack.operators import metering

ZONE, DAYS, PEAKS = "Asia/Shanghai", [1, 2, 3, 4, 5], [(540, 720), (840, 1080)]


@pytest.fixture(scope="module")
def card(spark):
    aliases = spark.createDataFrame([("chat", "chat"), ("chat-old", "chat")], "alias string, canonical string")
    rates = spark.createDataFrame(
        [("chat", "off_peak", dt.datetime(2026, 1, 1), "0.02", "1", "4"), ("chat", "peak", dt.datetime(2026, 1, 1), "0.04", "2", "8")],
        "canonical string, tariff string, effective_from timestamp, h string, m string, o string",
    ).select("canonical", "tariff", "effective_from", *(F.col(a).cast("decimal(18,6)").alias(b) for a, b in (("h", "hit_rate"), ("m", "miss_rate"), ("o", "output_rate"))))
    return aliases, rates


def price(spark, card, *calls):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "i int, model string, called_at timestamp, cache_hit_tokens long, cache_miss_tokens long, completion_tokens long")
    rows = rows.withColumn("model", metering.normalise_model(F.col("model"), ("vendor", "v")))
    return metering.cost(rows, *card, ZONE, DAYS, PEAKS).orderBy("i").collect()


def test_tariffs_and_states(spark, card):
    saturday, friday, m = dt.datetime(2026, 9, 19, 2), dt.datetime(2026, 9, 18, 1), 1_000_000
    got = price(
        spark, card, ("chat", saturday, m, m, m), (" V/Chat-Old ", friday, m, m, m), ("other", friday, m, m, m), ("chat", friday, -1, 0, 0), ("chat", dt.datetime(2025, 1, 1), m, m, m),
        ("chat", friday - dt.timedelta(seconds=1), 0, m, 0), ("chat", friday + dt.timedelta(hours=3), 0, m, 0), (None, friday, 1, 1, 1),
    )
    assert [(r.status, r.tariff) for r in got] == [
        ("priced", "off_peak"), ("priced", "peak"), ("unpriced", "peak"), ("invalid_usage", "peak"), ("unpriced", "off_peak"), ("priced", "off_peak"), ("priced", "off_peak"), ("unpriced", "peak"),
    ]
    assert [r.amount for r in got] == [pytest.approx(5.02), pytest.approx(10.04), None, None, None, 1.0, 1.0, None]


def test_usage_forms(spark):
    rows = spark.createDataFrame([(5, 7, 99, 3), (5, None, 12, 3), (9, None, 4, None), (None, None, 8, 1)], "h int, m int, p int, c int")
    got = rows.select(metering.normalise_usage(*(F.col(c) for c in "hmpc")).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in got] == [(5, 7, 3), (5, 7, 3), (9, 0, 0), (0, 8, 1)]


def test_deltas_of_cumulative_counters(spark):
    rows = spark.createDataFrame([("t", 1, 48, 10), ("t", 2, 52, 5), ("t", 3, 50, None), ("u", 1, None, 4)], "thread string, turn int, tools int, tokens int")
    got = {(r.thread, r.turn): (r.tools_delta, r.tokens_delta) for r in metering.turn_deltas(rows, "thread", "turn", ["tools", "tokens"], floored=("tools",)).collect()}
    assert got == {("t", 1): (48, 10), ("t", 2): (4, -5), ("t", 3): (0, -5), ("u", 1): (0, 4)}


def test_rate_windows_and_budgets(spark):
    at = lambda *a: dt.datetime(2024, 1, 1, *a)
    rows = spark.createDataFrame([(i, "k", at(0, 0, i), 100.0) for i in range(5)] + [(5, "k", at(0, 1, 0), 1.0), (6, "j", at(0, 0, 0), 500.0)], "request_id int, bucket string, ts timestamp, tokens double")
    got = {r.request_id: r.rejected for r in metering.rate_limited(rows, 3).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False, 6: False}
    got = {r.request_id: (r.used_before, r.refused) for r in metering.daily_budget(rows, 200, "tokens").collect()}
    assert got == {0: (0, False), 1: (100, False), 2: (200, True), 3: (300, True), 4: (400, True), 5: (500, True), 6: (0, False)}


def test_histogram_and_totals(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", None), ("a", 99.0)], "k string, v double")
    assert {r.bound_no: r.n_le for r in metering.histogram(rows, "v", [1.0, 10.0], ["k"]).collect()} == {0: 1, 1: 2, 2: 3}


def test_why_a_run_ends(spark):
    limits = {"rag_calls": 3, "rounds": 8, "batches": 5}
    rows = spark.createDataFrame([(3, True, True, 8, 5), (3, False, True, 8, 5), (0, True, True, 0, 5), (9, True, False, 9, 9), (2, True, True, 7, 4)], "r int, wr boolean, wt boolean, n int, b int")
    got = [r[0] for r in rows.select(metering.termination(F.col("r"), F.col("wr"), F.col("wt"), F.col("n"), F.col("b"), limits)).collect()]
    assert got == ["rag_call_budget_exhausted", "model_round_budget_exhausted", "tool_batch_budget_exhausted", None, None]
