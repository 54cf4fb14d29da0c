"""Usage, catalogues, ledgers, budget reports and running sums against plain recounts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import context, ingest, ledgers, usage
from tamarack.operators.running import running_sums

ITEM = "thread_id string, seq int, rank int, chunk_id string, source string, page int, tool_call_id string, message_id string, query string, excerpt string, truncated boolean"


def test_running_sums_of_a_hot_key_and_nulls(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.randint(-4, 9) if i % 7 else None) for i in range(400)]
    got = running_sums(spark.createDataFrame(rows, "k string, i int, v int").repartition(7), ["k"], ["i"], {"total": F.col("v"), "n": F.lit(1)})
    want, totals = {}, {}
    for k, i, v in rows:
        total, n = totals.get(k, (0, 0))
        totals[k] = want[i] = (total + (v or 0), n + 1)
    assert {r.i: (r.total, r.n) for r in got.collect()} == want
    assert running_sums(spark.createDataFrame([], "k string, i int, v int"), ["k"], ["i"], {"total": F.col("v")}).count() == 0


def test_batches_of_one_sequence(spark):
    rows = [("f" if i < 60 else f"g{i // 4}", i) for i in range(101)]
    got = ingest.batch_cut(spark.createDataFrame(rows, "file string, i int").repartition(5), 10, "file", ["i"]).collect()
    assert {r.i: r.batch for r in got} == {i: i // 10 for i in range(101)}
    done = {f: max(i // 10 for g, i in rows if g == f) for f, _ in rows}
    assert all(r.done_batch == done[r.file] for r in got) and len(got) == 101


def test_several_responses_and_running_counters(spark):
    kind = "thread string, n int, " + ", ".join(f"{c} long" for c in usage.COUNTS) + ", amount double, status string"
    rows = spark.createDataFrame([("t", 1, 5, 7, 3, None, 12, 15, 0.1, "priced"), ("t", 2, 1, 1, 1, 1, 2, 3, None, "unpriced"), ("t", 3, 0, 0, 2, 0, 0, 2, 0.2, "priced"), ("u", 1, None, None, None, None, None, None, None, None)], kind)
    one = {r.thread: r for r in usage.combined(rows, ["thread"]).collect()}
    assert (one["t"].total_tokens, one["t"].reasoning_tokens, one["t"].aggregated_model_calls, one["u"].total_tokens) == (20, 1, 3, 0)
    got = {(r.thread, r.n): (r.all_total_tokens, r.estimated_cost, r.unpriced_model_count, r.llm_call_count) for r in usage.running_usage(rows, "thread", "n").collect()}
    assert got == {("t", 1): (15, 0.1, 0, 1), ("t", 2): (18, 0.1, 1, 2), ("t", 3): (20, 0.3, 1, 3), ("u", 1): (0, 0.0, 1, 1)}


CARD = {
    "rate_card_version": "v7", "unit_tokens": 1_000_000, "timezone": "Asia/Shanghai",
    "models": {
        "chat": {"aliases": ["chat-old"], "effective_from": "2026-01-01 00:00:00", "rates": {"off_peak": {"cache_hit_input": "0.02", "cache_miss_input": 1, "output": 4}, "peak": {"cache_hit_input": 0.04, "cache_miss_input": 2, "output": 8}}, "peak_windows": {"weekdays": [1, 2, 3, 4, 5], "ranges": [{"start": "09:00", "end": "12:00"}]}},
        "flat": {"effective_from": "2026-01-01 00:00:00", "rates": {"off_peak": {"cache_hit_input": 0, "cache_miss_input": 1, "output": 1}, "peak": {"cache_hit_input": 9, "cache_miss_input": 9, "output": 9}}},
    },
}


def test_catalogue_prices_each_model_by_its_own_hours(spark, tmp_path):
    (tmp_path / "card.json").write_text(json.dumps(CARD))
    card = usage.load_catalogue(spark, f"file://{tmp_path}/card.json", prefixes=("v",))
    friday, m = dt.datetime(2026, 9, 18, 1), 1_000_000
    calls = spark.createDataFrame([(1, "chat-old", friday, m, m, m), (2, "flat", friday, m, m, m), (3, "chat", friday + dt.timedelta(hours=3), m, m, m), (4, "none", friday, 1, 1, 1)], "i int, model string, called_at timestamp, cache_hit_tokens long, cache_miss_tokens long, completion_tokens long")
    got = {r.i: (r.tariff, r.status, r.amount) for r in usage.price(calls, card).collect()}
    assert got == {1: ("peak", "priced", 10.04), 2: ("off_peak", "priced", 2.0), 3: ("off_peak", "priced", 5.02), 4: ("off_peak", "unpriced", None)}
    assert card.version == "v7" and usage.price(calls, card).first().rate_card_version == "v7"


@pytest.mark.parametrize("change", [
    {"models": {}}, {"unit_tokens": 0}, {"timezone": "Nowhere/None"}, {"models": {**CARD["models"], "other": {**CARD["models"]["flat"], "aliases": [" V/Chat-Old"]}}},
    {"models": {"x": {**CARD["models"]["flat"], "peak_windows": {"weekdays": [8]}}}}, {"models": {"x": {**CARD["models"]["flat"], "peak_windows": {"ranges": [{"start": "12:00", "end": "12:00"}]}}}},
    {"models": {"x": {**CARD["models"]["flat"], "rates": {**CARD["models"]["flat"]["rates"], "peak": {"cache_hit_input": -1, "cache_miss_input": 0, "output": 0}}}}},
])
def test_broken_catalogues_are_refused(spark, tmp_path, change):
    (tmp_path / "card.json").write_text(json.dumps(CARD | change))
    with pytest.raises((ValueError, KeyError)):
        usage.load_catalogue(spark, f"file://{tmp_path}/card.json", prefixes=("v",))


EVENT = "request_id string, seq int, at_ms long, event string, name string, content string, output string, tags array<string>, node string, kind string, is_root boolean, n_tool_calls int, prompt_tokens long, completion_tokens long, total_tokens long, model string, amount double, status string"


def _event(seq, event, **more):
    names = [c.split()[0] for c in EVENT.split(", ")]
    return tuple(({"request_id": "r", "seq": seq, "at_ms": seq * 10, "event": event} | more).get(n) for n in names)


def test_a_request_becomes_frames_and_totals(spark, tmp_path):
    stream, end = "on_chat_model_stream", "on_tool_end"
    outputs = ['{"ok": false}', '{"ok": "false"}', '{"ok": 0}', '{"ok": null}', '{"x": 1}', "[1]", "plain", None]
    events = [
        _event(1, stream, content=""), _event(2, stream, content="hidden", tags=["context_compaction"]), _event(3, stream, content="hidden", kind="finalizer"), _event(4, stream, content="hi"),
        _event(5, "on_tool_start", name="find", content='{"q":1}'), *(_event(10 + i, end, name="find", output=o) for i, o in enumerate(outputs)),
        _event(30, "on_chat_model_end", prompt_tokens=7, completion_tokens=2, total_tokens=9, model="m", amount=0.5, status="priced"),
        _event(31, "on_chat_model_end", prompt_tokens=1, completion_tokens=1, total_tokens=2, model="m", amount=0.5, status="unpriced"),
        _event(40, "on_chain_end", is_root=True, content=" ", n_tool_calls=0), _event(41, "on_chain_end", is_root=True, content="x", n_tool_calls=1), _event(42, "on_chain_end", is_root=False, content="x"),
        _event(43, "on_chain_end", is_root=True, content="answer"), ("s", 1, 70, "other", *[None] * 14),
    ]
    log = spark.createDataFrame(events, EVENT)
    got = {r.seq: (r.frame, json.loads(r.payload)) for r in usage.frames(log).where("request_id = 'r'").collect()}
    assert got[4] == ("token", {"delta": "hi"}) and got[5][1] == {"name": "find", "args": '{"q":1}'} and got[43] == ("answer_commit", {"content": "answer"})
    assert [got[10 + i][1]["ok"] for i in range(len(outputs))] == [False, True, False, False, True, True, True, True] and set(got) == {4, 5, *range(10, 18), 30, 31, 43}
    totals = {r.request_id: tuple(r)[1:] for r in usage.request_usage(log).collect()}
    assert totals == {"r": (11, 0.5, 1, 2, 430), "s": (0, 0.0, 0, 0, None)}
    assert [tuple(r) for r in usage.request_models(log).collect()] == [("r", "m", 8, 3, 0.5)]
    # The same totals from a stream that brings the log in two files.
    log.where("seq < 31").coalesce(1).write.parquet(f"{tmp_path}/log")
    log.where("seq >= 31").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = usage.request_usage(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"))
    query = stream.writeStream.format("memory").queryName("request_totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.request_id: tuple(r)[1:] for r in spark.table("request_totals").collect()} == totals


def _visible(items, capacity, chars):
    """The sequential rule, piece by piece."""
    out, omitted = {}, 0
    for i in sorted(items, key=lambda i: (i["seq"], i["rank"])):
        if not i["excerpt"]:
            continue
        if len(i["chunk_id"] or "") > 512 or len(i["source"] or "") > 512:
            omitted += 1
            continue
        key, cut = i["chunk_id"] or f"{i['tool_call_id'] or ''}:{i['rank'] - 1}", i["excerpt"][:chars]
        over, query = bool(i["truncated"]) or len(i["excerpt"]) > chars, i["query"] or ""
        if key not in out:
            if len(out) >= capacity:
                omitted += 1
                continue
            out[key] = [[], cut, over, i["source"], i["page"]]
        record = out[key]
        if query and query not in record[0] and len(record[0]) < 6:
            record[0].append(query)
        if len(cut) > len(record[1]):
            record[1:3] = [cut, over]
    return out, omitted


def _historical(items, capacity):
    out, omitted = {}, 0
    for i in sorted(items, key=lambda i: (i["seq"], i["rank"])):
        source, page = i["source"] or "", i["page"]
        key = i["chunk_id"] or (f"{source}:{page}" if source or page is not None else "") or (f"{i['tool_call_id']}:{i['rank']}" if i["tool_call_id"] else "")
        if not key or len(i["chunk_id"] or "") > 512 or len(source) > 512:
            omitted += 1
            continue
        record = out.setdefault(key, [[], i["source"], page, None, None])
        if i["query"] and i["query"] not in record[0] and len(record[0]) < 6:
            record[0].append(i["query"])
        record[3:] = [i["message_id"] or "", i["tool_call_id"] or ""]
    keys = list(out)[max(0, len(out) - capacity):]
    return {k: out[k] for k in keys}, omitted + len(out) - len(keys)


def test_ledgers_follow_the_sequential_rule(spark):
    rng = random.Random(11)
    pick = rng.choice
    items = []
    for thread in ("a", "b", "c", "hot"):
        for seq in range(60 if thread == "hot" else 6):
            call = pick(["", None, f"call{seq}"])
            for rank in range(1, 5):
                items.append({
                    "thread_id": thread, "seq": seq, "rank": rank, "chunk_id": pick([None, "", "k" * 600, *(f"c{n}" for n in range(9))]), "source": pick(["", None, "s", "t" * 513, "u"]), "page": pick([None, 1, 2]),
                    "tool_call_id": call, "message_id": pick([None, f"m{seq}"]), "query": pick([None, "", *(f"q{n}" for n in range(9))]), "excerpt": pick([None, "", "x" * rng.randint(1, 14), "y" * rng.randint(1, 14)]), "truncated": pick([None, True, False]),
                })
    names = [c.split()[0] for c in ITEM.split(", ")]
    frame = spark.createDataFrame([tuple(i[n] for n in names) for i in items], ITEM).withColumn("key", F.lit("clash")).repartition(5)
    for capacity in (4, 50):
        seen, past = ledgers.visible_ledger(frame, capacity, 8).collect(), ledgers.historical_ledger(frame, capacity).collect()
        for thread in ("a", "b", "c", "hot"):
            own = [i for i in items if i["thread_id"] == thread]
            want, omitted = _visible(own, capacity, 8)
            assert {r.key: [r.queries, r.excerpt, r.excerpt_truncated, r.source, r.page] for r in seen if r.thread_id == thread} == want
            assert {r.omitted for r in seen if r.thread_id == thread} == {omitted}
            want, omitted = _historical(own, capacity)
            assert {r.key: [r.queries, r.source, r.page, r.last_tool_message_id, r.last_tool_call_id] for r in past if r.thread_id == thread} == want
            assert {r.omitted for r in past if r.thread_id == thread} == {omitted}
    assert ledgers.visible_ledger(spark.createDataFrame([], ITEM)).count() == 0 and ledgers.historical_ledger(spark.createDataFrame([], ITEM)).count() == 0


def test_budget_report_sums(spark):
    messages = spark.createDataFrame([("t", 0, "human", "aa"), ("t", 1, "ai", None), ("t", 2, "human", "bbbb"), ("t", 3, "human", "cc"), ("t", 4, "tool", "dddddd")], "thread_id string, idx int, type string, content string")
    parts = ", ".join(f"{c} int" for c in ("limit", *context.PARTS, "evidence_tokens", *context.CUTS))
    requests = spark.createDataFrame([("t", 60, 10, 5, 3, None, 2, 9, 0, 4, 1), ("none", 1, 1, 1, 1, 1, 1, None, None, None, None)], f"thread_id string, {parts}")
    got = {r.thread_id: r for r in context.budget_report(messages, requests).collect()}
    t = got["t"]
    assert (t.recent_history_tokens, t.current_user_tokens, t.current_turn_other_tokens) == (5 + 4, 6, 5 + 7)
    assert (t.estimated_input_tokens, t.evidence_tokens, t.within) == (20 + 27, 11, True) and t.projection_reasons == ["evidence_excerpt_budget", "evidence_record_budget"]
    assert (got["none"].estimated_input_tokens, got["none"].within, got["none"].projection_reasons) == (5, False, [])
