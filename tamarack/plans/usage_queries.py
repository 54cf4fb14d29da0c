"""Queries over usage of calls, request logs, evidence ledgers, budget reports and files in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.operators import context, ingest, ledgers, usage
from tamarack.plans.operations_queries import PRICED_CTE, priced
from tamarack.session import table


def _calls(spark, sf_dir):
    """Priced calls with all counts; some have no reasoning tokens."""
    rows = priced(spark, sf_dir)
    counts = {
        "reasoning_tokens": F.when(F.col("request_id") % 3 > 0, F.col("request_id") % 7), "prompt_tokens": F.col("cache_hit_tokens") + F.col("cache_miss_tokens"),
        "total_tokens": F.col("cache_hit_tokens") + F.col("cache_miss_tokens") + F.col("completion_tokens"), "thread": F.col("request_id") % 23, "answer": F.floor(F.col("request_id") / 3).cast("long"),
    }
    return rows.withColumns(counts)


def usage_combined(spark, sf_dir):
    """Three responses to an answer, as one."""
    return usage.combined(_calls(spark, sf_dir), ["answer"])


def usage_running(spark, sf_dir):
    """Counters of 23 threads after each call."""
    rows = usage.running_usage(_calls(spark, sf_dir), "thread", "request_id")
    return rows.select("request_id", "thread", *(f"all_{c}" for c in usage.COUNTS), "estimated_cost", "unpriced_model_count", "llm_call_count")


def _log(spark, sf_dir):
    """Events as a log of requests: each user's events in turn stream, call a tool, end a call or end the root."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("on_chat_model_stream", "on_tool_start", "on_tool_end", "on_chat_model_end", "on_chain_end"))), (n % 5 + 1).cast("int"))
    output = F.when(n % 3 == 0, F.to_json(F.struct((n % 2 == 0).alias("ok"), F.col("props").alias("p")))).when(n % 3 == 1, F.lit("[1]")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("request_id"), n.alias("seq"), F.floor("value").cast("long").alias("at_ms"), kind.alias("event"), F.col("event_type").alias("name"),
        F.when(n % 4 > 0, F.col("props")).alias("content"), output.alias("output"), F.when(n % 6 == 0, F.array(F.lit("context_compaction"))).alias("tags"), F.when(n % 8 == 0, "compact_history").alias("node"),
        F.when(n % 7 == 0, "finalizer").alias("kind"), (n % 2 == 0).alias("is_root"), (n % 3).alias("n_tool_calls"), (n % 11).alias("prompt_tokens"), (n % 13).alias("completion_tokens"),
        (n % 11 + n % 13).alias("total_tokens"), F.concat(F.lit("m"), (n % 2).cast("string")).alias("model"), F.when(n % 5 < 4, n % 10 * 0.5).cast("double").alias("amount"), F.when(n % 9 > 1, "priced").otherwise("unpriced").alias("status"),
    )


def request_frames(spark, sf_dir):
    """Frames of each request by kind, and how many tools failed."""
    rows = usage.frames(_log(spark, sf_dir))
    return rows.groupBy("request_id", "frame").agg(F.count("*").alias("n"), F.count_if(F.get_json_object("payload", "$.ok") == "false").alias("failed"), F.sum(F.length(F.get_json_object("payload", "$.delta"))).alias("shown_chars"))


def request_usage(spark, sf_dir):
    return usage.request_usage(_log(spark, sf_dir))


def request_models(spark, sf_dir):
    return usage.request_models(_log(spark, sf_dir))


def _evidence(spark, sf_dir):
    """Events as evidence, five pieces to a call, some without chunk ids, places, calls or texts."""
    n = F.col("event_id")
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    call = F.floor(n / 5).cast("long")
    return table(spark, sf_dir, "events").select(
        (call % 37).alias("thread_id"), call.alias("seq"), (n % 5 + 1).alias("rank"), F.when(n % 4 == 0, named("c", n % 199)).when(n % 41 == 0, F.repeat(F.lit("x"), F.lit(600))).alias("chunk_id"),
        F.when(n % 4 < 3, named("s", F.col("user_id") % 9)).otherwise("").alias("source"), F.when(n % 3 > 0, n % 5).alias("page"), F.when(call % 7 > 0, named("t", call)).alias("tool_call_id"),
        named("m", call).alias("message_id"), F.when(n % 5 > 0, named("q", F.col("user_id") % 12)).alias("query"), F.when(n % 6 > 0, F.repeat(F.col("event_type"), (n % 9 * 10).cast("int"))).alias("excerpt"), (n % 10 == 0).alias("truncated"),
    )


def _shown(rows, *more):
    return rows.select("thread_id", "key", "seq", "rank", "source", "page", F.array_join("queries", ",").alias("queries"), "omitted", *more)


def ledger_visible(spark, sf_dir):
    return _shown(ledgers.visible_ledger(_evidence(spark, sf_dir)), "excerpt", "excerpt_truncated")


def ledger_historical(spark, sf_dir):
    return _shown(ledgers.historical_ledger(_evidence(spark, sf_dir)), "last_tool_message_id", "last_tool_call_id")


def budget_report(spark, sf_dir):
    """Every conversation's next request, with parts of its own; every seventh conversation's messages are not there."""
    talks = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "human").otherwise("ai")
    messages = talks.where("conv_id % 7 > 0").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("idx"), kind.alias("type"), F.col("text").alias("content"))
    n = F.col("thread_id")
    parts = {
        "limit": 200 + n % 17 * 60, "system_tokens": F.lit(60), "directive_tokens": F.when(n % 2 == 0, 25), "tool_schema_tokens": n % 5 * 20, "summary_tokens": n % 3 * 40, "historical_evidence_tokens": n % 4 * 15,
        "evidence_tokens": n % 6 * 10, "tool_content_chars_removed": n % 2, "evidence_excerpt_chars_removed": n % 3, "evidence_records_omitted": F.when(n % 5 > 0, n % 2),
    }
    requests = talks.select(F.col("conv_id").alias("thread_id")).distinct().select("thread_id", *(value.alias(name) for name, value in parts.items()))
    report = context.budget_report(messages, requests)
    return report.withColumn("projection_reasons", F.array_join("projection_reasons", ","))


def batch_sequence(spark, sf_dir):
    """All line items as one sequence of batches, orders as files."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    cut = ingest.batch_cut(rows, 50, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return cut.groupBy("batch", "done_batch").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


QUERIES = {f.__name__: f for f in (usage_combined, usage_running, request_frames, request_usage, request_models, ledger_visible, ledger_historical, budget_report, batch_sequence)}

_CALLS = f"""{PRICED_CTE}, k AS (SELECT n, n % 23 AS thread, n // 3 AS answer, hit AS cache_hit_tokens, miss AS cache_miss_tokens, o AS completion_tokens, CASE WHEN n % 3 > 0 THEN n % 7 ELSE 0 END AS reasoning_tokens,
  hit + miss AS prompt_tokens, hit + miss + o AS total_tokens, status, CASE WHEN status = 'priced' THEN amount ELSE 0 END AS amount FROM p)"""
_LOG = """l AS (SELECT user_id % 40 AS request_id, event_id AS n, CAST(floor(value) AS BIGINT) AS at_ms, event_id % 5 AS kind, CASE WHEN event_id % 4 > 0 THEN props ELSE '' END AS content, event_id % 9 > 1 AS priced,
  CASE WHEN event_id % 5 < 4 THEN event_id % 10 * 0.5::DOUBLE END AS amount FROM events),
f AS (SELECT *, CASE WHEN kind = 0 AND content <> '' AND n % 6 > 0 AND n % 8 > 0 AND n % 7 > 0 THEN 'token' WHEN kind = 1 THEN 'tool_call' WHEN kind = 2 THEN 'tool_result' WHEN kind = 3 THEN 'usage'
  WHEN kind = 4 AND content <> '' AND n % 2 = 0 AND n % 3 = 0 THEN 'answer_commit' END AS frame FROM l)"""
_ITEMS = """i AS (SELECT event_id // 5 % 37 AS thread_id, event_id // 5 AS seq, event_id % 5 + 1 AS rank, event_id AS n, user_id, event_type FROM events),
e AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'c' || (n % 199) END AS chunk_id, n % 4 > 0 AND n % 41 = 0 AS long, CASE WHEN n % 4 < 3 THEN 's' || (user_id % 9) ELSE '' END AS source, CASE WHEN n % 3 > 0 THEN n % 5 END AS page,
  CASE WHEN seq % 7 > 0 THEN 't' || seq ELSE '' END AS call, CASE WHEN n % 5 > 0 THEN 'q' || (user_id % 12) ELSE '' END AS query, CASE WHEN n % 6 > 0 THEN repeat(event_type, (n % 9 * 10)::INT) ELSE '' END AS content FROM i)"""
_QUERIES = """a AS (SELECT thread_id, key, query, min((seq, rank)) AS pos FROM x WHERE key IS NOT NULL AND query <> '' GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY thread_id, key ORDER BY pos) AS n FROM a), q AS (SELECT thread_id, key, string_agg(query, ',' ORDER BY n) AS queries FROM b WHERE n <= 6 GROUP BY ALL)"""
_SIZE = "(strlen(coalesce(text, '')) + 1) // 2 + 4"

ORACLES = {
    "usage_combined": f"""WITH {_CALLS} SELECT answer, {", ".join(f"sum({c})::BIGINT AS {c}" for c in usage.COUNTS)}, count(*) AS aggregated_model_calls FROM k GROUP BY answer""",
    "usage_running": f"""WITH {_CALLS} SELECT n AS request_id, thread, {", ".join(f"sum({c}) OVER w::BIGINT AS all_{c}" for c in usage.COUNTS)}, sum(amount::DECIMAL(24, 12)) OVER w::DOUBLE AS estimated_cost,
      sum((status <> 'priced')::INT) OVER w::BIGINT AS unpriced_model_count, count(*) OVER w AS llm_call_count FROM k WINDOW w AS (PARTITION BY thread ORDER BY n)""",
    "request_frames": f"""WITH {_LOG} SELECT request_id, frame, count(*) AS n, count(*) FILTER (frame = 'tool_result' AND n % 3 = 0 AND n % 2 = 1) AS failed, sum(CASE WHEN frame = 'token' THEN length(content) END)::BIGINT AS shown_chars
      FROM f WHERE frame IS NOT NULL GROUP BY ALL""",
    "request_usage": f"""WITH {_LOG} SELECT request_id, coalesce(sum(CASE WHEN kind = 3 THEN n % 11 + n % 13 END), 0)::BIGINT AS total_tokens, coalesce(sum(CASE WHEN kind = 3 AND priced THEN amount END), 0) AS total_cost,
      count(*) FILTER (kind = 3 AND NOT priced) AS unpriced_model_count, count(*) FILTER (kind = 3) AS n_calls, coalesce(max(at_ms) FILTER (frame = 'answer_commit'), min(at_ms) FILTER (frame = 'token')) AS ttft_ms FROM f GROUP BY request_id""",
    "request_models": f"""WITH {_LOG} SELECT request_id, 'm' || (n % 2) AS model, sum(n % 11)::BIGINT AS prompt_tokens, sum(n % 13)::BIGINT AS completion_tokens, coalesce(sum(CASE WHEN priced THEN amount END), 0) AS cost FROM f WHERE kind = 3 GROUP BY ALL""",
    "ledger_visible": f"""WITH {_ITEMS}, x AS (SELECT *, CASE WHEN NOT long THEN coalesce(chunk_id, call || ':' || (rank - 1)) END AS key, left(content, 240) AS cut, length(content) > 240 OR n % 10 = 0 AS over FROM e WHERE content <> ''),
      {_QUERIES}, g AS (SELECT thread_id, key, min((seq, rank)) AS pos, count(*) AS c, arg_min(source, (seq, rank)) AS source, arg_min((page, 0), (seq, rank))[1] AS page, arg_max((cut, over), (length(cut), -seq, -rank)) AS best FROM x WHERE key IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS place FROM g), o AS (SELECT thread_id, sum(CASE WHEN place > 18 THEN c ELSE 0 END) AS late FROM r GROUP BY ALL), y AS (SELECT thread_id, count(*) AS bad FROM x WHERE key IS NULL GROUP BY ALL)
      SELECT thread_id, r.key, pos[1] AS seq, pos[2] AS rank, source, page, coalesce(queries, '') AS queries, (late + coalesce(bad, 0))::BIGINT AS omitted, best[1] AS excerpt, best[2] AS excerpt_truncated
      FROM r JOIN o USING (thread_id) LEFT JOIN y USING (thread_id) LEFT JOIN q USING (thread_id, key) WHERE place <= 18""",
    "ledger_historical": f"""WITH {_ITEMS}, x AS (SELECT *, CASE WHEN NOT long THEN coalesce(chunk_id, CASE WHEN source <> '' OR page IS NOT NULL THEN source || ':' || coalesce(page::VARCHAR, 'None') END, CASE WHEN call <> '' THEN call || ':' || rank END) END AS key FROM e),
      {_QUERIES}, g AS (SELECT thread_id, key, min((seq, rank)) AS pos, arg_min(source, (seq, rank)) AS source, arg_min((page, 0), (seq, rank))[1] AS page, 'm' || max(seq) AS last_tool_message_id, arg_max(call, (seq, rank)) AS last_tool_call_id FROM x WHERE key IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos DESC) AS place, count(*) OVER (PARTITION BY thread_id) AS keys FROM g), y AS (SELECT thread_id, count(*) AS bad FROM x WHERE key IS NULL GROUP BY ALL)
      SELECT thread_id, r.key, pos[1] AS seq, pos[2] AS rank, source, page, coalesce(queries, '') AS queries, greatest(0, keys - 64) + coalesce(bad, 0) AS omitted, last_tool_message_id, last_tool_call_id
      FROM r LEFT JOIN y USING (thread_id) LEFT JOIN q USING (thread_id, key) WHERE place <= 64""",
    "budget_report": f"""WITH m AS (SELECT conv_id AS thread_id, turn AS idx, role = 'user' AS human, {_SIZE} AS t FROM conversations WHERE conv_id % 7 > 0),
      o AS (SELECT *, (human AND NOT coalesce(lag(human) OVER w, false))::INT AS opens FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY idx)), u AS (SELECT *, greatest(sum(opens) OVER (PARTITION BY thread_id ORDER BY idx), 1) AS turn FROM o),
      v AS (SELECT *, turn = max(turn) OVER (PARTITION BY thread_id) AS now FROM u), s AS (SELECT thread_id, sum(t) AS whole, sum(CASE WHEN NOT now THEN t ELSE 0 END) AS history, arg_min(t, idx) FILTER (now) AS first FROM v GROUP BY ALL),
      g AS (SELECT DISTINCT conv_id AS n FROM conversations), p AS (SELECT n, 60 AS system_tokens, CASE WHEN n % 2 = 0 THEN 25 ELSE 0 END AS directive_tokens, n % 5 * 20 AS tool_schema_tokens, n % 3 * 40 AS summary_tokens, n % 4 * 15 AS historical_evidence_tokens,
        coalesce(whole, 0) AS whole, coalesce(history, 0) AS history, coalesce(first, 0) AS first FROM g LEFT JOIN s ON n = thread_id), z AS (SELECT *, 60 + directive_tokens + tool_schema_tokens + summary_tokens + historical_evidence_tokens + whole AS total FROM p)
      SELECT n AS thread_id, 200 + n % 17 * 60 AS input_limit_tokens, total::BIGINT AS estimated_input_tokens, system_tokens, directive_tokens, tool_schema_tokens, summary_tokens, historical_evidence_tokens, first AS current_user_tokens, (whole - history - first)::BIGINT AS current_turn_other_tokens,
        n % 6 * 10 + historical_evidence_tokens AS evidence_tokens, history::BIGINT AS recent_history_tokens, total <= 200 + n % 17 * 60 AS within,
        concat_ws(',', CASE WHEN n % 2 > 0 THEN 'tool_payload_budget' END, CASE WHEN n % 3 > 0 THEN 'evidence_excerpt_budget' END, CASE WHEN n % 5 > 0 AND n % 2 > 0 THEN 'evidence_record_budget' END) AS projection_reasons FROM z""",
    "batch_sequence": """WITH b AS (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 50 AS batch FROM lineitem), d AS (SELECT *, max(batch) OVER (PARTITION BY l_orderkey) AS done_batch FROM b)
      SELECT batch, done_batch, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM d GROUP BY ALL""",
}
