"""Turns, budgets, pairing and ledgers on hand-made threads."""

import pytest

from tamarack.operators import conversation

MESSAGE = "thread_id string, idx int, type string, content string"


@pytest.fixture(scope="module")
def thread(spark):
    kinds = ["ai", "human", "human", "ai", "tool", "human", "ai"]
    return spark.createDataFrame([("t", i, k, f"{k}{i}") for i, k in enumerate(kinds)], MESSAGE).repartition(3)


def test_turns(thread):
    got = {r.idx: r.turn for r in conversation.turns(thread).collect()}
    # What leads the first human message belongs to the first turn.
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}
    assert {r.idx for r in conversation.completed(thread).collect()} == {0, 1, 2, 3, 4}


def test_humans_merge(thread):
    got = [(r.idx, r.type, r.content, r.n) for r in conversation.merge_humans(thread).orderBy("idx").collect()]
    assert got == [(0, "ai", "ai0", 1), (1, "human", "human1\n\nhuman2", 2), (3, "ai", "ai3", 1), (4, "tool", "tool4", 1), (5, "human", "human5", 1), (6, "ai", "ai6", 1)]


def test_an_oversized_turn_ends_the_history(spark):
    sizes = [10, 400, 10, 400]
    rows = spark.createDataFrame([("t", i, "human" if i % 2 == 0 else "ai", "x" * (sizes[i // 2] if i % 2 else 2)) for i in range(8)], MESSAGE)
    got = {r.turn: r.kept for r in conversation.history_within(rows, 100).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}
    got = {r.turn: r.kept for r in conversation.history_within(rows, 250).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    got = {r.turn: r.compact for r in conversation.compaction_prefix(rows, 100, recent=1).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_misses_since_the_last_hit(spark):
    rows = [("a", 0, True, False), ("a", 1, True, True), ("a", 2, True, False), ("a", 3, False, False), ("a", 4, True, False), ("b", 0, True, False), ("c", 0, True, True)]
    got = {r.thread_id: r.misses for r in conversation.miss_streak(spark.createDataFrame(rows, "thread_id string, idx int, ok boolean, has_content boolean")).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}


def test_tool_results_pair_with_calls(spark):
    kind = "thread_id string, call_id string, tool string"
    calls = spark.createDataFrame([("t", "1", "a"), ("t", "2", "a"), ("t", "3", "a"), ("t", "4", "a"), ("u", "1", "a")], kind)
    results = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", "3", "a"), ("t", "3", "a"), ("t", "9", "a"), ("u", "1", "a")], kind)
    got = {(r.thread_id, r.call_id): r.state for r in conversation.pair_tools(calls, results).collect()}
    assert got == {("t", "1"): "paired", ("t", "2"): "mismatch", ("t", "3"): "duplicate", ("t", "4"): "missing", ("t", "9"): "orphan", ("u", "1"): "paired"}


def test_ledger_keeps_one_row_a_chunk(spark):
    kind = "thread_id string, seq int, chunk_id string, source string, page int, query string, excerpt string"
    rows = spark.createDataFrame([("t", 1, "a::1", "s", 1, "q1", "old"), ("t", 2, "a::1", "s", 1, "q2", "new"), ("t", 3, "", "s", 4, "q1", "x"), ("t", 4, None, "", None, "q3", "only text")], kind)
    got = conversation.evidence_ledger(rows, 2).orderBy("seq").collect()
    assert [(r.seq, r.omitted) for r in got] == [(3, 1), (4, 1)] and got[0].key == "s#4" and len(got[1].key) == 64
    first = conversation.evidence_ledger(rows, 9).where("key = 'a::1'").first()
    assert (first.queries, first.excerpt, first.omitted) == (["q1", "q2"], "new", 0)
    seen = conversation.unseen(conversation.evidence_ledger(rows, 9), conversation.evidence_ledger(rows, 2))
    assert [r.key for r in seen.collect()] == ["a::1"]


def test_logs(spark):
    rows = spark.createDataFrame([("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b"), ("r", 4, "a"), ("s", 1, None), ("s", 2, None)], "request_id string, seq int, state string")
    assert [(r.request_id, r.seq) for r in conversation.progress(rows).orderBy("request_id", "seq").collect()] == [("r", 1), ("r", 3), ("r", 4)]
    assert {(r.request_id, r.seq) for r in conversation.merge_log(rows, ["request_id"], "seq").collect()} == {("r", 4), ("s", 2)}
    assert {r.seq for r in conversation.last_n(rows.where("request_id = 'r'"), "request_id", "seq", 2).collect()} == {3, 4}


def test_page_runs_follow_the_ids_as_text(spark):
    rows = spark.createDataFrame([("f", "p_1", 1, "a"), ("f", "p_10", 2, "b"), ("f", "p_2", 1, "c"), ("f", "p_3", 1, "d")], "source_file string, chunk_id string, page int, content string")
    got = [(r.page, r.page_text, r.n) for r in conversation.page_runs(rows).orderBy("run").collect()]
    assert got == [(1, "a", 1), (2, "b", 1), (1, "c\n\nd", 2)]


def test_display(thread, spark):
    more = thread.union(spark.createDataFrame([("t", 9, "ai", "  ")], MESSAGE))
    assert [(r.idx, r.role) for r in conversation.display(more).orderBy("idx").collect()] == [(0, "assistant"), (1, "user"), (2, "user"), (3, "assistant"), (5, "user"), (6, "assistant")]
