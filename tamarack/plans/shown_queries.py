"""Queries over dictionary terms, references in tool results, and what fits into a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import terms
from tamarack.operators import context, evidence
from tamarack.session import documents, table

#: Phrases and words of the test texts, one within another.
PHRASES = ["of the", "of the thing", "the", "in the", "de la", "en la", "et la", "le la", "und die", "die der", "der", "que de", "los"]
CAPS = (None, *context.TOOL_CHARS)


def dictionary_terms(spark, sf_dir):
    """How often each phrase is the longest match in each document."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(terms.dictionary_terms(F.col("text"), PHRASES)).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def json_references(spark, sf_dir):
    """References of line items, nested below their orders' results, some without a page, some with an object only around them."""
    n = F.col("l_linenumber")
    item = F.struct(
        F.when(n % 3 > 0, F.concat(F.lit("supplier"), "l_suppkey")).alias("source_file"), F.when(n % 3 == 0, F.concat(F.lit("part"), "l_partkey")).alias("source"), F.when(n % 2 == 0, n).alias("page"),
        F.struct(F.array(F.struct(F.concat(F.lit("c"), "l_partkey").alias("chunk_id"))).alias("items")).alias("more"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", item.alias("item"))
    calls = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "item"))).alias("found"))
    payload = F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(F.transform("found", lambda x: x["item"]).alias("results")).alias("data")))
    found = evidence.references(calls.select(F.col("l_orderkey").alias("message_id"), payload.alias("content")))
    return found.select("message_id", "position", "source", "page", "chunk_id", "reference")


def context_budget(spark, sf_dir):
    """Every conversation's next request within a limit of its own; long answers of odd turns are tool results."""
    kind = F.when(F.col("role") == "user", "human").when((F.col("turn") % 4 == 1) & (F.length("text") > 300), "tool").otherwise("ai")
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("idx"), kind.alias("type"), F.col("text").alias("content"))
    n = F.col("thread_id")
    budgets = messages.select("thread_id").distinct().select(
        "thread_id", (100 + n % 17 * 90).alias("limit"), F.lit(60).alias("system_tokens"), (n % 5 * 20).alias("schema_tokens"), (n % 3 * 40).alias("summary_tokens"), (n % 9).alias("n_records"), F.lit(15).alias("record_tokens")
    )
    return context.fit_budget(messages, budgets)


QUERIES = {f.__name__: f for f in (dictionary_terms, json_references, context_budget)}

_LONGEST = "|".join(sorted(PHRASES, key=len, reverse=True))
_SIZE = "(strlen(content) + 1) // 2 + 4"


def _capped(cap: int | None) -> str:
    return _SIZE if cap is None else f"CASE WHEN type = 'tool' THEN (strlen(substr(content, 1, {cap})) + 1) // 2 + 4 ELSE {_SIZE} END"


_EARLY = " UNION ALL ".join(
    f"SELECT thread_id, dropped * 6 + {k} AS level, dropped AS dropped_turns, {'NULL' if c is None else c} AS tool_chars, true AS summary_kept, n_records AS records_kept, NULL AS current_tool_chars, s{k} AS completed_tokens, current0 AS current_tokens FROM e" for k, c in enumerate(CAPS)
)
_LATE = " UNION ALL ".join(
    [
        "SELECT thread_id, gone * 6, gone, NULL, true, n_records, NULL, 0, current0 FROM b", "SELECT thread_id, gone * 6 + 1 + i, gone, NULL, false, n_records >> i, NULL, 0, current0 FROM b, range(0, 21) r(i)",
        *(f"SELECT thread_id, gone * 6 + {22 + k}, gone, NULL, false, 0, {c}, 0, current{k + 1} FROM b" for k, c in enumerate(context.TOOL_CHARS)),
    ]
)

ORACLES = {
    "dictionary_terms": rf"""SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\b(?:{_LONGEST})\b')) AS term FROM documents) GROUP BY ALL""",
    "json_references": """WITH i AS (SELECT row_number() OVER () AS rid, l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 3 > 0 THEN 'supplier' || l_suppkey ELSE 'part' || l_partkey END AS source, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS page, l_partkey AS p FROM lineitem),
      r AS (SELECT rid, id, n, p, source AS s, 0 AS k, source, page, NULL AS chunk_id FROM i UNION ALL SELECT rid, id, n, p, source, 1, NULL, NULL, 'c' || p FROM i)
      SELECT id AS message_id, CAST(row_number() OVER (PARTITION BY id ORDER BY n, p, s, rid, k) AS INT) AS position, source, page, chunk_id,
        '消息 ' || id || coalesce('；来源 ' || source, '') || coalesce('；页码 ' || page, '') || coalesce('；chunk_id ' || chunk_id, '') AS reference FROM r""",
    "context_budget": f"""WITH m AS (SELECT conv_id AS thread_id, turn AS idx, CASE WHEN role = 'user' THEN 'human' WHEN turn % 4 = 1 AND length(text) > 300 THEN 'tool' ELSE 'ai' END AS type, coalesce(text, '') AS content FROM conversations),
      o AS (SELECT *, (type = 'human' AND coalesce(lag(type) OVER (PARTITION BY thread_id ORDER BY idx) <> 'human', true))::INT AS opens FROM m),
      t AS (SELECT *, greatest(sum(opens) OVER (PARTITION BY thread_id ORDER BY idx), 1) AS turn FROM o),
      u AS (SELECT thread_id, turn, {", ".join(f"sum({_capped(c)})::BIGINT AS c{k}" for k, c in enumerate(CAPS))}, sum(CASE WHEN type = 'human' THEN {_SIZE} ELSE 0 END)::BIGINT AS user_tokens FROM t GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY thread_id) AS turns FROM u),
      g AS (SELECT thread_id, 100 + thread_id % 17 * 90 AS lim, 60 AS system_tokens, thread_id % 5 * 20 AS schema_tokens, thread_id % 3 * 40 AS summary, thread_id % 9 AS n_records FROM (SELECT DISTINCT thread_id FROM m)),
      b AS (SELECT p.thread_id, turns - 1 AS gone, user_tokens, {", ".join(f"c{k} AS current{k}" for k in range(6))}, g.* EXCLUDE (thread_id) FROM p JOIN g USING (thread_id) WHERE back = 1),
      e AS (SELECT p.thread_id, turns - back AS dropped, {", ".join(f"sum(p.c{k}) OVER (PARTITION BY p.thread_id ORDER BY turn DESC)::BIGINT AS s{k}" for k in range(6))}, b.current0, b.n_records FROM p JOIN b USING (thread_id) WHERE back > 1),
      l AS ({_EARLY} UNION ALL {_LATE}),
      f AS (SELECT l.*, CASE WHEN summary_kept THEN summary ELSE 0 END AS summary_tokens, records_kept * 15 AS evidence_tokens, lim, system_tokens, schema_tokens FROM l JOIN g USING (thread_id)),
      w AS (SELECT *, system_tokens + schema_tokens + summary_tokens + evidence_tokens + completed_tokens + current_tokens AS total_tokens FROM f),
      k AS (SELECT * FROM w WHERE total_tokens <= lim QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY level) = 1),
      x AS (SELECT b.thread_id, CASE WHEN b.system_tokens + b.schema_tokens > b.lim THEN 'FIXED_CONTEXT_TOO_LARGE' WHEN b.system_tokens + b.schema_tokens + user_tokens > b.lim THEN 'USER_INPUT_TOO_LARGE' WHEN level IS NULL THEN 'CURRENT_TURN_CONTEXT_TOO_LARGE' ELSE 'within_budget' END AS outcome,
        b.system_tokens, b.schema_tokens, user_tokens, k.* EXCLUDE (thread_id, system_tokens, schema_tokens, lim, level) FROM b LEFT JOIN k USING (thread_id))
      SELECT thread_id, outcome, system_tokens, schema_tokens, user_tokens, {", ".join(f"CASE WHEN outcome = 'within_budget' THEN {c} END AS {c}" for c in ("dropped_turns", "tool_chars", "summary_kept", "records_kept", "current_tool_chars", "summary_tokens", "evidence_tokens", "completed_tokens", "current_tokens", "total_tokens"))} FROM x""",
}
