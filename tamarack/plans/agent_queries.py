"""Evidence, history, verdict, index and sampling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import conversation, dataset, evidence, retrieval
from tamarack.plans.evaluation_queries import judged
from tamarack.plans.operations_queries import TURNS_CTE, messages
from tamarack.plans.retrieval_queries import BM25_CTE, K, questions
from tamarack.session import checkpoint_folder, documents, table

BUDGET = 60


def envelope_decode(spark, sf_dir):
    """Events as tool envelopes, some of them broken, with either spelling of source and page."""
    n = F.col("event_id")
    result = F.struct(
        F.col("props").alias("content"), F.when(n % 2 == 0, F.col("event_type")).alias("source"), F.when(n % 2 == 1, F.concat("event_type", F.lit(".pdf"))).alias("source_file"),
        F.when(n % 2 == 0, (n % 5).cast("int")).alias("page"), F.when(n % 2 == 1, (n % 3).cast("int")).alias("source_page"), F.concat(F.lit("c"), n.cast("string")).alias("chunk_id"),
    )
    results = F.when(n % 4 == 3, F.array().cast(f"array<{'struct<content:string,source:string,source_file:string,page:int,source_page:int,chunk_id:string>'}>")).otherwise(F.array(result))
    error = F.when(n % 5 == 0, F.struct(F.lit("TIMEOUT").alias("code"), F.lit("late").alias("message")))
    whole = F.to_json(F.struct((n % 5 != 0).alias("ok"), F.lit("rag").alias("tool"), F.lit("q").alias("query"), error.alias("error"), F.struct(results.alias("results")).alias("data")))
    rows = table(spark, sf_dir, "events").select("event_id", evidence.decode(F.when(n % 7 == 0, F.lit("no {json")).otherwise(whole)).alias("e"))
    first = F.get("e.results", F.lit(0))
    return rows.select("event_id", "e.ok", "e.error_code", "e.relevant", first["source"].alias("source"), first["page"].alias("page"), first["chunk_id"].alias("chunk_id"))


def payload_fair_share(spark, sf_dir):
    """Line items of an order as texts as long as their quantity."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("call_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("position"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("content")
    )
    return evidence.fair_share(rows, BUDGET).select("call_id", F.length("content").alias("chars"), "allowed")


def payload_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return evidence.within_length(rows, 200, "user_id", "event_id", ["event_id", "event_type"])


def web_results(spark, sf_dir):
    result = lambda i: F.struct(F.repeat(F.col("source"), i * 20).alias("title"), F.concat(F.lit("u"), i.cast("string")).alias("url"), F.col("text").alias("content"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(1), F.lit(7)), result).alias("r"))
    cut = rows.select("doc_id", evidence.web_results(F.col("r")).alias("r"))
    return cut.select("doc_id", F.size("r").alias("n"), F.array_join(F.transform("r", lambda x: F.length(x["title"]).cast("string")), ",").alias("titles"), F.md5(F.get("r", F.lit(0))["content"]).alias("digest"))


def _calls(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch_id"), n.alias("position"), F.when(n % 10 == 0, " ").otherwise(F.col("event_type")).alias("tool"), F.when(n % 6 > 0, n % 6 < 5).alias("ok"), (n % 4 == 0).alias("has_content")
    )


def tool_admission(spark, sf_dir):
    return evidence.admit_calls(_calls(spark, sf_dir), ["signup"], ["view", "click"], 3).select("position", "state")


def call_summary(spark, sf_dir):
    return evidence.call_summary(_calls(spark, sf_dir), ["batch_id"])


def _items(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), n.alias("position"), F.when(n % 9 > 0, F.col("event_type")).otherwise("").alias("source"), F.when(n % 2 == 0, (n % 3).cast("int")).alias("page"))


def source_summary(spark, sf_dir):
    return evidence.source_summary(_items(spark, sf_dir), ["thread_id"], 4)


def source_pages(spark, sf_dir):
    rows = evidence.source_pages(_items(spark, sf_dir), ["thread_id"])
    return rows.select("thread_id", "source", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def final_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    n = F.col("event_id")
    place = [F.col("user_id").alias("thread_id"), n.alias("position"), F.concat(F.lit("c"), (n % 40).cast("string")).alias("chunk_id"), F.col("event_type").alias("source"), F.when(n % 3 > 0, (n % 3).cast("int")).alias("page")]
    web = rows.where("event_id % 4 = 3").select(F.col("user_id").alias("thread_id"), n.alias("position"), F.concat(F.lit("u"), (n % 30).cast("string")).alias("url"))
    found = evidence.final_evidence(rows.where("event_id % 4 = 0").select(*place), rows.where("event_id % 2 = 0").select(*place), web, 12)
    return found.select("thread_id", "kind", "position", "chunk_id", "source", "page", "url", "rank")


def metric_lines(spark, sf_dir):
    """Orders as financial metrics."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("company"), F.lit("total").alias("metric"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), F.when(F.col("o_orderkey") % 3 > 0, "CNY").alias("unit"),
        F.date_format("o_orderdate", "yyyy").alias("year"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("is_estimate"), F.when(F.col("o_orderkey") % 4 > 0, F.lit("f.pdf")).alias("source_file"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5).alias("source_page"),
    )
    return evidence.format_metric(rows).select("o_orderkey", "line", "is_estimate")


def completed_history(spark, sf_dir):
    return conversation.completed_history(messages(spark, sf_dir)).select("thread_id", "idx", "turn")


def context_report(spark, sf_dir):
    return conversation.context_report(messages(spark, sf_dir), 600)


def summary_cursor(spark, sf_dir):
    """Summaries of the first few messages of each thread; every fifth names a wrong message."""
    rows = messages(spark, sf_dir)
    size = F.col("thread_id") % 4 + 1
    ids = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when((F.col("thread_id") % 5 == 0) & (i == 0), F.lit(99)).otherwise(i + F.col("least")).cast("bigint"))
    summaries = rows.groupBy("thread_id").agg(F.min("idx").alias("least")).select("thread_id", ids.alias("ids"))
    return conversation.summary_valid(rows, summaries)


def judge_verdicts(spark, sf_dir):
    """Verdicts for three documents in four, some of them twice; an empty text falls back to an empty response."""
    rows = judged(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "behavior").where("case_id % 4 > 0")
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    return dataset.with_verdicts(records, rows.unionByName(rows), text.clear_abstention(F.col("text"))).select("case_id", "judged", "behavior")


def index_topk(spark, sf_dir):
    """BM25 from a persisted index, built once for its corpus version."""
    index = retrieval.LexicalIndex(spark, f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}", "1")
    index.build(documents(spark, sf_dir))
    index.build(documents(spark, sf_dir))
    return index.topk(questions(spark, sf_dir), K, epsilon=None).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def document_page(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source")
    return retrieval.paginate(rows, ["source", "doc_id"], 25, 50)


def request_normalise(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 8 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("query"), F.when(n % 3 > 0, (n % 20 - 3).cast("int")).alias("top_k"), F.when(n % 5 == 0, "other").when(n % 5 == 1, " BM25").alias("mode"))
    return retrieval.requests(rows)


def seeded_sample(spark, sf_dir):
    return dataset.seeded_sample(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 15, seed="7")


def disjoint_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_file"), F.col("l_orderkey").alias("chunk_id")).agg(F.min("l_orderkey").alias("page"))
    rows = rows.withColumn("page", (F.col("page") / 60).cast("int"))
    return dataset.disjoint_neighbours(rows, seed="0")


def disjoint_pairs_unordered(spark, sf_dir):
    """Pages that don't follow the ids, so that pairs of a source meet in any order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_file"), F.col("l_orderkey").alias("chunk_id")).agg(F.min("l_orderkey").alias("page"))
    rows = rows.withColumn("page", (F.col("page") * 7919 % 211).cast("int"))
    return dataset.disjoint_neighbours(rows, seed="0")


def rejection_counts(spark, sf_dir):
    from tamarack.plans.evaluation_queries import evidence_check

    return dataset.rejections(evidence_check(spark, sf_dir).withColumn("reasons", F.split("reasons", ";")))


def nfkc_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(text.nfkc_tokens(F.col("text"))).alias("n_tokens"))


def critical_sentences(spark, sf_dir):
    found = text.critical_sentences(F.col("text"), "[0-9]")
    return documents(spark, sf_dir).select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


def _disjoint_sql(page: str) -> str:
    """The seeded order of each source's pairs, gone through one by one with the chunks that are taken."""
    return f"""WITH RECURSIVE c AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS o FROM lineitem),
      n AS (SELECT s, o AS x, {page} AS p, lead(o) OVER w AS y, lead({page}) OVER w AS q FROM c WINDOW w AS (PARTITION BY s ORDER BY {page}, o)),
      p AS (SELECT s, least(x, y) AS a, greatest(x, y) AS b FROM n WHERE y IS NOT NULL AND abs(q - p) <= 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('0|' || s || '|' || a || '|' || b)) AS k FROM p),
      g AS (SELECT s, a, b, k, true AS kept, [a, b] AS used FROM k WHERE k = 1
        UNION ALL SELECT k.s, k.a, k.b, k.k, NOT list_has_any(g.used, [k.a, k.b]), CASE WHEN list_has_any(g.used, [k.a, k.b]) THEN g.used ELSE list_concat(g.used, [k.a, k.b]) END
        FROM k JOIN g ON k.s = g.s AND k.k = g.k + 1)
      SELECT s AS source_file, a, b FROM g WHERE kept"""


QUERIES = {
    f.__name__: f
    for f in (
        envelope_decode, payload_fair_share, payload_prefix, web_results, tool_admission, call_summary, source_summary, source_pages, final_evidence, metric_lines, completed_history,
        context_report, summary_cursor, judge_verdicts, index_topk, document_page, request_normalise, seeded_sample, disjoint_pairs, disjoint_pairs_unordered, rejection_counts, nfkc_tokens, critical_sentences,
    )
}

ORACLES = {
    "envelope_decode": """SELECT event_id, event_id % 7 > 0 AND event_id % 5 > 0 AS ok, CASE WHEN event_id % 7 = 0 THEN 'INVALID' WHEN event_id % 5 = 0 THEN 'TIMEOUT' END AS error_code,
      event_id % 7 > 0 AND event_id % 4 < 3 AS relevant, CASE WHEN event_id % 7 > 0 AND event_id % 4 < 3 THEN event_type || CASE WHEN event_id % 2 = 1 THEN '.pdf' ELSE '' END END AS source,
      CASE WHEN event_id % 7 > 0 AND event_id % 4 < 3 THEN nullif(CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE event_id % 3 END, 0) END AS page,
      CASE WHEN event_id % 7 > 0 AND event_id % 4 < 3 THEN 'c' || event_id END AS chunk_id FROM events""",
    "payload_fair_share": f"""WITH i AS (SELECT l_orderkey AS call_id, l_quantity::INT AS s FROM lineitem),
      t AS (SELECT call_id, sum(s) AS total, list(s) AS ss FROM i GROUP BY call_id),
      l AS (SELECT call_id, total, list_max(list_filter(range(0, 51), lambda v: list_sum(list_transform(ss, lambda x: least(x, v))) <= {BUDGET})) AS level FROM t)
      SELECT call_id, s AS chars, CASE WHEN total <= {BUDGET} THEN s ELSE least(s, level) END AS allowed FROM i JOIN l USING (call_id)""",
    "payload_prefix": """WITH r AS (SELECT user_id, event_id, event_type, sum(length('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
      SELECT user_id, event_id, event_type FROM r WHERE s <= 200""",
    "web_results": """WITH d AS (SELECT doc_id, source, trim(text, '@BLANK@') AS c FROM documents)
      SELECT doc_id, 5 AS n, array_to_string(list_transform(range(1, 6), lambda i: least(length(source) * 20 * i, 200)), ',') AS titles,
        md5(CASE WHEN length(c) > 800 THEN rtrim(substr(c, 1, 797), '@BLANK@') || '...' ELSE c END) AS digest FROM d""",
    "tool_admission": """WITH c AS (SELECT user_id, event_id AS position, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type END AS tool FROM events),
      u AS (SELECT *, count_if(tool IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY position) AS used FROM c)
      SELECT position, CASE WHEN tool = 'signup' THEN 'disabled' WHEN tool IN ('view', 'click') AND used > 3 THEN 'no_slot' ELSE 'admitted' END AS state FROM u""",
    "call_summary": """SELECT user_id AS batch_id, count(*) AS runs, count_if(event_id % 6 IN (0, 5)) AS errors, count_if(event_id % 6 BETWEEN 1 AND 4 AND event_id % 4 = 0) AS retrieved,
      arg_max(CASE WHEN event_id % 10 = 0 THEN ' ' ELSE event_type END, event_id) FILTER (event_id % 6 BETWEEN 1 AND 4) AS last_ok FROM events GROUP BY user_id""",
    "source_summary": """WITH f AS (SELECT user_id AS thread_id, event_type AS source, CASE WHEN event_id % 2 = 0 THEN event_id % 3 END AS page, min(event_id) AS seen FROM events WHERE event_id % 9 > 0 GROUP BY ALL),
      r AS (SELECT thread_id, source, page, row_number() OVER (PARTITION BY thread_id ORDER BY seen) AS rank, count(*) OVER (PARTITION BY thread_id) AS n_sources FROM f) SELECT * FROM r WHERE rank <= 4""",
    "source_pages": """SELECT user_id AS thread_id, CASE WHEN event_id % 9 > 0 THEN event_type ELSE '' END AS source, coalesce(string_agg(DISTINCT (event_id % 3)::VARCHAR, ',' ORDER BY (event_id % 3)::VARCHAR) FILTER (event_id % 2 = 0), '') AS pages
      FROM events GROUP BY 1, 2""",
    "final_evidence": """WITH e AS (SELECT user_id AS thread_id, event_id AS position, 'c' || (event_id % 40) AS chunk_id, event_type AS source, nullif(event_id % 3, 0) AS page FROM events),
      l AS (SELECT * FROM e WHERE position % 4 = 0),
      g AS (SELECT * FROM e WHERE position % 2 = 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.thread_id = e.thread_id AND l.chunk_id = e.chunk_id AND l.source = e.source AND l.page IS NOT DISTINCT FROM e.page)
        QUALIFY row_number() OVER (PARTITION BY thread_id, chunk_id, source, page ORDER BY position) = 1),
      w AS (SELECT user_id AS thread_id, event_id AS position, 'u' || (event_id % 30) AS url FROM events WHERE event_id % 4 = 3 QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 30 ORDER BY event_id) = 1),
      a AS (SELECT 0 AS k, 'ledger' AS kind, *, NULL AS url FROM l UNION ALL SELECT 1, 'generic', *, NULL FROM g UNION ALL SELECT 2, 'web', thread_id, position, NULL, NULL, NULL, url FROM w)
      SELECT thread_id, kind, position, chunk_id, source, page, url, row_number() OVER (PARTITION BY thread_id ORDER BY k, position) AS rank FROM a QUALIFY rank <= 12""",
    "metric_lines": r"""SELECT o_orderkey, (o_orderstatus = 'O')::INT AS is_estimate, o_orderpriority || ' total (' || strftime(o_orderdate, '%Y') || '): ' || CAST(o_totalprice AS DECIMAL(18,2)) || ' ' || CASE WHEN o_orderkey % 3 > 0 THEN 'CNY' ELSE '' END
      || CASE WHEN o_orderstatus = 'O' THEN ' [estimate]' ELSE '' END || CASE WHEN o_orderkey % 4 > 0 THEN ' (f.pdf' || CASE WHEN o_orderkey % 5 > 0 THEN ' p.' || (o_orderkey % 5) ELSE '' END || ')' ELSE '' END AS line FROM orders""",
    "completed_history": f"""WITH {TURNS_CTE}, c AS (SELECT * FROM t QUALIFY turn < max(turn) OVER (PARTITION BY thread_id)), s AS (SELECT * FROM c WHERE type IN ('human', 'ai') AND trim(coalesce(text, ''), '@BLANK@') <> '')
      SELECT thread_id, idx, turn FROM s QUALIFY type = 'human' OR idx = max(idx) FILTER (type = 'ai') OVER (PARTITION BY thread_id, turn)""",
    "context_report": f"""WITH {TURNS_CTE}, x AS (SELECT *, (strlen(coalesce(text, '')) + 1) // 2 + 4 AS k, turn = max(turn) OVER (PARTITION BY thread_id) AS now FROM t)
      SELECT thread_id, sum(k)::BIGINT AS total_tokens, coalesce(sum(k) FILTER (type = 'human'), 0)::BIGINT AS human_tokens, coalesce(sum(k) FILTER (type = 'ai'), 0)::BIGINT AS ai_tokens, 0 AS tool_tokens,
        coalesce(sum(k) FILTER (type = 'system'), 0)::BIGINT AS system_tokens, coalesce(sum(k) FILTER (now), 0)::BIGINT AS current_tokens, coalesce(sum(k) FILTER (NOT now), 0)::BIGINT AS history_tokens, sum(k) <= 600 AS within FROM x GROUP BY thread_id""",
    "summary_cursor": f"""WITH {TURNS_CTE}, n AS (SELECT *, row_number() OVER o AS n, coalesce(lead(turn) OVER o <> turn, true) AS ends, idx - min(idx) OVER (PARTITION BY thread_id) AS off FROM t WINDOW o AS (PARTITION BY thread_id ORDER BY idx))
      SELECT thread_id, thread_id % 5 <> 0 AND count(*) FILTER (n <= thread_id % 4 + 1) = thread_id % 4 + 1 AND coalesce(bool_and(off = n - 1) FILTER (n <= thread_id % 4 + 1), false)
        AND coalesce(bool_or(ends) FILTER (n = thread_id % 4 + 1), false) AS valid FROM n GROUP BY thread_id""",
    "judge_verdicts": """WITH r AS (SELECT doc_id AS case_id, n_chars % 11 AS m, trim(text, '@BLANK@') AS t FROM documents)
      SELECT case_id, case_id % 4 > 0 AS judged, CASE WHEN case_id % 4 = 0 THEN CASE WHEN coalesce(t, '') = '' THEN 'empty_response' ELSE 'judge_error' END WHEN m < 5 THEN 'supported_answer' WHEN m < 7 THEN 'abstention'
        WHEN m < 9 THEN ' Unsupported_Answer ' WHEN m < 10 THEN 'empty_response' ELSE 'odd' END AS behavior FROM r""",
    "index_topk": f"WITH {BM25_CTE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm",
    "document_page": """WITH d AS (SELECT doc_id, source, count(*) OVER () AS total, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents WHERE lang = 'en')
      SELECT doc_id, source, total, total > 75 AS has_more FROM d WHERE n BETWEEN 51 AND 75""",
    "request_normalise": """SELECT event_id, event_type AS query, CASE WHEN event_id % 3 > 0 THEN greatest(1, least(10, event_id % 20 - 3)) ELSE 5 END AS top_k, CASE WHEN event_id % 5 = 1 THEN 'bm25' ELSE 'hybrid' END AS mode
      FROM events WHERE event_id % 8 > 0 AND event_id % 5 > 0""",
    "seeded_sample": "SELECT item_id FROM benchmark ORDER BY md5('7|' || item_id), item_id LIMIT 15",
    "disjoint_pairs": _disjoint_sql("o // 60"),
    "disjoint_pairs_unordered": _disjoint_sql("o * 7919 % 211"),
    "critical_sentences": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？；\n]*[.!?。！？；\n]|[^.!?。！？；\n]+$'), lambda x: trim(x, '@BLANK@')), lambda x: x <> '') AS f FROM documents),
      c AS (SELECT doc_id, flatten(list_transform(f, lambda x: CASE WHEN length(x) > 500 THEN list_transform(list_filter(range(1, length(x) + 1, 500), lambda a: regexp_matches(substr(x, a, 500), '[0-9]')),
          lambda a: CASE WHEN a > 1 THEN '…' ELSE '' END || trim(substr(x, a, 500), '@BLANK@') || CASE WHEN a + 500 <= length(x) THEN '…' ELSE '' END)
        WHEN regexp_matches(x, '[0-9]') THEN [x] ELSE [] END)) AS f FROM s), u AS (SELECT doc_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM c)
      SELECT doc_id, len(f) AS n, md5(array_to_string(f, '|')) AS digest FROM u""",
}


def _rejections_sql() -> str:
    from tamarack.plans.evaluation_queries import ORACLES as EVALUATION

    return f"""SELECT reason, count(*) AS n FROM (SELECT unnest(list_transform(string_split(reasons, ';'), lambda r: split_part(r, ':', 1))) AS reason
      FROM ({EVALUATION["evidence_check"]}) WHERE NOT accepted) GROUP BY reason"""


ORACLES["rejection_counts"] = _rejections_sql()
