"""Dictionary terms, references in JSON and request budgets against plain loops."""

import json
import random
import re

from pyspark.sql import functions as F

from tamarack.functions import terms, text
from tamarack.operators import context, evidence, retrieval


def plain_terms(value, listed):
    """At each place the longest listed term whose ASCII edges are word edges."""
    value, out, at = terms.normal(value), [], 0
    known = sorted({terms.normal(t).strip() for t in listed} - {""}, key=len, reverse=True)
    edge = lambda a, b: not (re.match("[a-z0-9]", a or " ") and re.match("[a-z0-9]", b or " "))
    while at < len(value):
        for t in known:
            end = at + len(t)
            if value.startswith(t, at) and edge(value[at - 1 : at] if at else "", t[0]) and edge(t[-1], value[end : end + 1]):
                out.append(t)
                at = end
                break
        else:
            at += 1
    return out


def test_terms_are_the_plain_longest_matches(spark):
    rng = random.Random(3)
    listed = ["同比", "同比增长", "ab", "ab c", "abc", "b", "c1", "ＡＢ d", "毛利率", "", "é"]
    texts = [None, "", "同比增长 同比", "AB C abc xab ab.", "hbm4毛利率c1", "ab" * 20_000] + ["".join(rng.choices("ab c1dé同比增长.", k=rng.randrange(40))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", terms.dictionary_terms(F.col("t"), listed).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: plain_terms(t, listed) for i, t in enumerate(texts)}


def test_a_dictionary_changes_what_is_found_and_the_fingerprint(spark, tmp_path):
    docs = spark.createDataFrame([(1, "公司毛利率上升"), (2, "毛 利 率"), (3, "利率 毛利"), *((i, "公司") for i in range(4, 14))], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "毛利率")], "query_id bigint, query string")
    tokenizer = terms.with_terms()
    best = lambda t: {r.doc_id: round(r.score, 6) for r in retrieval.bm25_topk(asked, docs, 5, tokenizer=t, epsilon=None).collect()}
    plain, listed = best(text.search_tokens), best(tokenizer)
    assert listed[1] - listed[3] > plain[1] - plain[3] and set(listed) == set(plain)
    one = docs.where("doc_id = 1").select(tokenizer(F.col("text")).alias("t")).first().t
    assert one.count("毛利率") == 1 and one[:2] == ["公", "司"]
    assert docs.select(terms.with_terms(["HBM4"])(F.lit("HBM4 x")).alias("t")).first().t == ["hbm4", "x"]
    first = retrieval.LexicalIndex(spark, f"file://{tmp_path}", "1", tokenizer, terms.terms_version())
    other = retrieval.LexicalIndex(spark, f"file://{tmp_path}", "1", tokenizer, terms.terms_version(["x"]))
    assert first.fingerprint != other.fingerprint and terms.terms_version(["Ab", "c"]) == terms.terms_version(["c", "ＡＢ"])
    first.build(docs)
    assert {r.doc_id: round(r.score, 6) for r in first.topk(asked, 5, epsilon=None).collect()} == listed


def test_references_of_any_depth_in_order(spark):
    payload = {"z": [{"source": "s1", "page": 0, "deep": {"a": [{"chunk_id": 7, "excerpt": "x"}]}}, {"source_file": "", "source": "s2", "source_page": None, "page": 3}], "source_file": "top", "content": "text", "b": {"page": "iv"}, "n": {"chunk_id": "", "source": None}}
    rows = [(1, json.dumps(payload)), (2, "no json"), (3, None), (4, "[" * 100_000), (5, '[[{"source": {"k": 1}}], {"source": "x"}]'), (6, '"text"')]
    got = {}
    for r in evidence.references(spark.createDataFrame(rows, "message_id bigint, content string")).orderBy("message_id", "position").collect():
        got.setdefault(r.message_id, []).append((r.source, r.page, r.chunk_id, r.content))
    assert got == {1: [("top", None, None, "text"), ("s1", "0", None, None), (None, None, "7", "x"), ("s2", None, None, None), (None, "iv", None, None)], 5: [('{"k": 1}', None, None, None), ("x", None, None, None)]}
    line = evidence.references(spark.createDataFrame(rows[:1], "message_id bigint, content string")).where("position = 2").first().reference
    assert line == "消息 1；来源 s1；页码 0"


def loop(messages, b):
    """One thread's request, by trying one measure after another."""
    size = lambda m, cap=None: (len((m[1] if cap is None or m[0] != "tool" else m[1][:cap]).encode()) + 1) // 2 + 4
    parts = []
    for kind, content in messages:
        if not parts or kind == "human" and parts[-1][-1][0] != "human":
            parts.append([])
        parts[-1].append((kind, content or ""))
    if len(parts) > 1 and all(k != "human" for k, _ in parts[0]):
        parts[:2] = [parts[0] + parts[1]]  # what stands before the first human message belongs to turn 1
    done, current = parts[:-1], parts[-1]
    fixed, summary, records = b["system"] + b["schema"], True, b["records"]
    if fixed > b["limit"]:
        return ("FIXED_CONTEXT_TOO_LARGE",)
    if fixed + sum(size(m) for m in current if m[0] == "human") > b["limit"]:
        return ("USER_INPUT_TOO_LARGE",)
    dropped = 0

    def total(cap=None, now=None):
        return fixed + (b["summary"] if summary else 0) + records * b["record"] + sum(size(m, cap) for t in done for m in t) + sum(size(m, now) for m in current)

    while True:
        if total() <= b["limit"]:
            return ("within_budget", dropped, None, summary, records, None, total())
        if done:
            for cap in context.TOOL_CHARS:
                if total(cap) <= b["limit"]:
                    return ("within_budget", dropped, cap, summary, records, None, total(cap))
            done, dropped = done[1:], dropped + 1
        elif summary:
            summary = False
        elif records:
            records //= 2
        else:
            for cap in context.TOOL_CHARS:
                if total(None, cap) <= b["limit"]:
                    return ("within_budget", dropped, None, summary, records, cap, total(None, cap))
            return ("CURRENT_TURN_CONTEXT_TOO_LARGE",)


def test_budgets_are_the_plain_loop(spark):
    rng = random.Random(9)
    threads, budgets = {}, {}
    for t in range(250):
        threads[t] = [(rng.choice(["human", "ai", "tool", "tool"]), rng.choice([None, "é" * rng.randrange(60), "x" * rng.randrange(3_000)])) for _ in range(rng.randrange(1, 9))]
        budgets[t] = {"limit": rng.choice([50, 200, 800, 2_000, 6_000]), "system": rng.randrange(60), "schema": rng.randrange(40), "summary": rng.choice([0, 90]), "records": rng.randrange(0, 14), "record": rng.choice([0, 25])}
    messages = spark.createDataFrame([(t, i, k, c, "clash") for t, rows in threads.items() for i, (k, c) in enumerate(rows)], "thread_id int, idx int, type string, content string, turn string").drop("turn")
    given = spark.createDataFrame([(t, *(b[k] for k in ("limit", "system", "schema", "summary", "records", "record"))) for t, b in budgets.items()], "thread_id int, limit long, system_tokens long, schema_tokens long, summary_tokens long, n_records long, record_tokens long")
    got = {}
    for r in context.fit_budget(messages, given).collect():
        got[r.thread_id] = (r.outcome, r.dropped_turns, r.tool_chars, r.summary_kept, r.records_kept, r.current_tool_chars, r.total_tokens) if r.outcome == "within_budget" else (r.outcome,)
    want = {t: loop(threads[t], budgets[t]) for t in threads}
    assert got == want and len({w[0] for w in want.values()}) == 4
    assert {w[2] for w in want.values() if len(w) > 1} >= {None, 0, 256} and any(len(w) > 1 and not w[3] for w in want.values())
