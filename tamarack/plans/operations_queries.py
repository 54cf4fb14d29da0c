"""Metering, conversation, ingestion, cache and pass-through SQL queries."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from tamarack.operators import cache, conversation, ingest, metering
from tamarack.plans import sql_guard
from tamarack.session import documents, table
from tamarack.sources import readers

# --- metering: events stand for requests -----------------------------------------------------------------

ZONE, WEEKDAYS, PEAKS = "Asia/Shanghai", [1, 2, 3, 4, 5], [(540, 720), (840, 1080)]
LIMITS = {"rag_calls": 3, "rounds": 8, "batches": 5}


def requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 20).alias("bucket"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens"), "event_type", "value"
    )


def usage(spark, sf_dir):
    n = F.col("event_id")
    model = F.when(n % 4 == 0, " Vendor/Fast-Old").when(n % 4 == 1, "fast").when(n % 4 == 2, "slow").otherwise("unknown")
    counts = metering.normalise_usage(F.when(n % 3 == 0, F.floor("value").cast("long")), F.when(n % 5 == 0, n % 100), F.floor(F.col("value") * 2).cast("long"), F.when(n % 101 == 0, -1).otherwise(n % 50))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("called_at"), model.alias("model"), counts.alias("u")).select("request_id", "called_at", "model", "u.*")


def _price_card(spark):
    """A card of two models, one of them with a second version, of a few rows."""
    aliases = spark.createDataFrame([("fast", "fast"), ("fast-old", "fast"), ("slow", "slow")], "alias string, canonical string")
    rows = [
        ("fast", "off_peak", "2023-01-01 00:00:00", "0.02", "1.00", "4.00"), ("fast", "peak", "2023-01-01 00:00:00", "0.04", "2.00", "8.00"),
        ("fast", "off_peak", "2024-01-15 00:00:00", "0.03", "1.50", "5.00"), ("fast", "peak", "2024-01-15 00:00:00", "0.06", "3.00", "9.00"),
        ("slow", "off_peak", "2024-01-10 00:00:00", "0.10", "2.00", "8.00"), ("slow", "peak", "2024-01-10 00:00:00", "0.20", "4.00", "16.00"),
    ]
    rates = spark.createDataFrame(rows, "canonical string, tariff string, at string, h string, m string, o string").select(
        "canonical", "tariff", F.to_timestamp("at").alias("effective_from"),
        *(F.col(a).cast("decimal(18,6)").alias(b) for a, b in (("h", "hit_rate"), ("m", "miss_rate"), ("o", "output_rate"))),
    )
    return aliases, rates


def priced(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumn("model", metering.normalise_model(F.col("model"), ("vendor",)))
    return metering.cost(rows, *_price_card(spark), ZONE, WEEKDAYS, PEAKS)


PRICED_CTE = """
u AS (SELECT event_id AS n, ts, CASE event_id % 4 WHEN 0 THEN 'fast-old' WHEN 1 THEN 'fast' WHEN 2 THEN 'slow' ELSE 'unknown' END AS model,
  CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS hit, CAST(floor(value * 2) AS BIGINT) AS prompt, CASE WHEN event_id % 101 = 0 THEN -1 ELSE event_id % 50 END AS o, ts + INTERVAL 8 HOUR AS local FROM events),
w AS (SELECT *, CASE WHEN n % 5 = 0 THEN n % 100 ELSE greatest(0, prompt - hit) END AS miss, CASE WHEN model IN ('fast', 'fast-old') THEN 'fast' WHEN model = 'slow' THEN 'slow' END AS canonical,
  CASE WHEN isodow(local) <= 5 AND ((hour(local) * 60 + minute(local) BETWEEN 540 AND 719) OR (hour(local) * 60 + minute(local) BETWEEN 840 AND 1079)) THEN 'peak' ELSE 'off_peak' END AS tariff FROM u),
c AS (SELECT *, CASE WHEN tariff = 'peak' THEN 2 ELSE 1 END AS f, ts >= TIMESTAMP '2024-01-15' AS late, canonical = 'fast' OR (canonical = 'slow' AND ts >= TIMESTAMP '2024-01-10') AS known FROM w),
p AS (SELECT *, CASE WHEN NOT coalesce(known, false) THEN 'unpriced' WHEN hit < 0 OR miss < 0 OR o < 0 THEN 'invalid_usage' ELSE 'priced' END AS status,
  CASE WHEN canonical = 'slow' THEN (hit * 0.10 + miss * 2.0 + o * 8.0) * f WHEN NOT late THEN (hit * 0.02 + miss * 1.0 + o * 4.0) * f
    ELSE hit * 0.03 * f + miss * 1.5 * f + o * CASE WHEN tariff = 'peak' THEN 9.0 ELSE 5.0 END END / 1000000 AS amount FROM c)
"""


def cost_estimate(spark, sf_dir):
    return priced(spark, sf_dir).select("request_id", "canonical", "tariff", "status", "cache_miss_tokens", F.round("amount", 9).alias("amount"))


def model_totals(spark, sf_dir):
    return metering.model_totals(priced(spark, sf_dir))


def turn_delta(spark, sf_dir):
    counters = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("turn"), F.floor("value").cast("long").alias("tools"), (F.col("event_id") * 2).alias("tokens"))
    return metering.turn_deltas(counters, "thread", "turn", ["tools", "tokens"], floored=("tools",))


def rate_limit(spark, sf_dir):
    return metering.rate_limited(requests(spark, sf_dir), 1).select("request_id", "bucket", "position", "rejected")


def daily_budget(spark, sf_dir):
    return metering.daily_budget(requests(spark, sf_dir), 500, "tokens").select("request_id", "used_before", "refused")


def latency_histogram(spark, sf_dir):
    return metering.histogram(table(spark, sf_dir, "events"), "value", [10.0, 50.0, 100.0, 500.0], ["event_type"])


def termination_reason(spark, sf_dir):
    n = F.col("event_id")
    why = metering.termination(n % 5, n % 2 == 0, n % 3 != 0, n % 11, n % 7, LIMITS)
    return table(spark, sf_dir, "events").groupBy(F.coalesce(why, F.lit("none")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum(metering.recursion_minimum(n % 11, n % 7)).alias("recursion"), F.sum(metering.input_limit(F.lit(60), n % 100, F.lit(10), n % 3)).alias("inputs")
    )


# --- conversations ------------------------------------------------------------------------------------------


def messages(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise("system")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("idx"), kind.alias("type"), F.col("text").alias("content"))


def tool_calls(spark, sf_dir):
    """Events as tool calls of a user, and results that are partly missing, repeated, orphaned or of another tool."""
    events = table(spark, sf_dir, "events")
    n = F.col("event_id")
    calls = events.where("event_type <> 'signup'").select(F.col("user_id").alias("thread_id"), n.alias("call_id"), F.col("event_type").alias("tool"))
    copies = F.when(n % 7 == 0, F.array(F.lit(1), F.lit(2))).when(n % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    results = events.select(F.col("user_id").alias("thread_id"), n.alias("call_id"), F.when(n % 11 == 0, "other").otherwise(F.col("event_type")).alias("tool"), F.explode(copies).alias("c")).drop("c")
    return calls, results


TURNS_CTE = """
m AS (SELECT conv_id AS thread_id, turn AS idx, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS type, text FROM conversations),
b AS (SELECT *, type = 'human' AND coalesce(lag(type) OVER (PARTITION BY thread_id ORDER BY idx), '') <> 'human' AS opens FROM m),
t AS (SELECT *, greatest(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY idx), 1)::BIGINT AS turn FROM b),
z AS (SELECT thread_id, turn, sum((strlen(coalesce(text, '')) + 1) // 2 + 4)::BIGINT AS tokens FROM t GROUP BY ALL)
"""


def turn_segments(spark, sf_dir):
    return conversation.turns(messages(spark, sf_dir)).select("thread_id", "idx", "turn")


def completed_turns(spark, sf_dir):
    return conversation.completed(messages(spark, sf_dir)).select("thread_id", "idx", "turn")


def history_budget(spark, sf_dir):
    return conversation.history_within(messages(spark, sf_dir), 600)


def compaction_prefix(spark, sf_dir):
    return conversation.compaction_prefix(messages(spark, sf_dir), 400, recent=1)


def merge_humans(spark, sf_dir):
    rows = conversation.merge_humans(messages(spark, sf_dir))
    return rows.select("thread_id", "idx", "type", F.md5("content").alias("digest"), "n")


def display_messages(spark, sf_dir):
    return conversation.display(messages(spark, sf_dir)).select("thread_id", "idx", "role", F.length("content").alias("chars"))


def miss_streak(spark, sf_dir):
    n = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), n.alias("idx"), (F.col("event_type") != "error").alias("ok"), (n % 4 == 0).alias("has_content"))
    return conversation.miss_streak(calls)


def last_n(spark, sf_dir):
    return conversation.last_n(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


def tool_pairing(spark, sf_dir):
    return conversation.pair_tools(*tool_calls(spark, sf_dir))


def evidence_ledger(spark, sf_dir):
    n = F.col("event_id")
    items = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("thread_id"), n.alias("seq"), F.when(n % 3 == 0, F.concat(F.lit("c"), (n % 9).cast("string"))).otherwise("").alias("chunk_id"),
        F.col("event_type").alias("source"), (n % 2).alias("page"), F.concat(F.lit("q"), (n % 6).cast("string")).alias("query"), F.col("props").alias("excerpt"),
    )
    rows = conversation.evidence_ledger(items, capacity=4, queries=3)
    return rows.select("thread_id", "key", "source", "page", "seq", F.array_join("queries", ",").alias("queries"), "omitted")


def unseen_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("key"), "event_id")
    return conversation.unseen(rows, rows.where("event_id % 9 = 0")).groupBy("thread_id").agg(F.count("*").alias("n"))


def message_log_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("id"), "event_id", "event_type", F.round("value", 4).alias("value"))
    return conversation.merge_log(rows, ["id"], "event_id")


def progress_states(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return conversation.progress(rows)


# --- ingestion ----------------------------------------------------------------------------------------------


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.md5("text").alias("hash"), "doc_id", "n_chars")


def changed_files(spark, sf_dir):
    """Against a manifest in which longer files are older versions and very short ones are missing."""
    now = files(spark, sf_dir)
    manifest = now.where("n_chars > 300").select("path", F.when(F.col("n_chars") > 3000, "older").otherwise(F.col("hash")).alias("hash"))
    return ingest.changed_files(now.select("path", "hash"), manifest)


def chunk_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    old = rows.select("doc_id", F.md5("text").alias("digest"), F.lit(1).alias("version"))
    new = rows.where("lang = 'fr'").select((F.col("doc_id") + 100).alias("doc_id"), F.md5("source").alias("digest"), F.lit(2).alias("version"))
    return ingest.upsert(old, new, "doc_id", "version")


def insert_or_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    old = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("N").alias("l_returnflag"))
    return ingest.insert_or_ignore(old, rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"])


def batch_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return ingest.batch_cut(rows, 50, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey"], lane="l_suppkey")


def row_to_text(spark, sf_dir):
    from tamarack.functions.text import row_text

    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")))
    return rows.select("c_custkey", row_text(["c_name", "c_nationkey", "c_mktsegment"]).alias("content"))


def page_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_file"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("chunk_id"), F.floor(F.col("l_quantity") / 20).alias("page"), F.col("l_returnflag").alias("content"))
    return conversation.page_runs(rows)


def split_text(spark, sf_dir):
    return ingest.split_text(documents(spark, sf_dir), "doc_id", "text").select("chunk_id", F.length("content").alias("chars"))


def page_plans(spark, sf_dir):
    pages = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(ingest.page_segments(pages)).alias("segments"), F.element_at(ingest.page_segments(pages), -1)["end"].alias("last_page"),
        F.array_join(ingest.sample_pages(pages, 5).cast("array<string>"), ",").alias("sampled"),
    )


def pdf_route(spark, sf_dir):
    profile = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("bytes_per_page"), (F.col("l_quantity") * 4).alias("text_chars_per_page"),
        (F.col("l_discount") * 5).alias("image_area_ratio"), (F.col("l_tax") * 5).alias("table_like_pages_ratio"), F.lit(0.0).alias("multi_column_pages_ratio"),
    )
    rows = ingest.route(profile, 50_000, 40, 0.4, 0.35, 0.5)
    return rows.groupBy("parser", "ocr", F.array_join("reasons", ";").alias("reasons")).agg(F.count("*").alias("n"))


def parse_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.groupBy(F.col("source").alias("source_file")).agg((F.count("*") / 4).cast("int").alias("pages"))
    rows = docs.select(F.col("source").alias("source_file"), F.when(F.col("n_chars") % 10 > 0, (F.col("doc_id") % 30).cast("int")).alias("page"), F.col("text").alias("content"))
    found = ingest.parse_quality(rows, pages)
    return found.select("source_file", "pages", "n", "page_coverage", "chars_per_page", "replacement_ratio", "traceable_ratio", F.array_join("reasons", ";").alias("reasons"), "acceptable")


def block_layout(spark, sf_dir):
    """Line items as text blocks of an order's pages, parts as tables: body filter, table overlap, reading order."""
    q = F.col("l_quantity")
    blocks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("block"), (q * 10).alias("x0"), F.col("l_discount").alias("d"), (q * 10 + 80).alias("x1"),
        (F.col("l_tax") * 10000).alias("y0"), (F.col("l_tax") * 10000 + 20).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.col("l_returnflag").alias("text"),
    )
    tables = blocks.where("d > 0.05").select("doc", "page", (F.col("x0") + 10).alias("x0"), "y0", F.col("x1").alias("x1"), (F.col("y1") - 5).alias("y1"))
    kept = ingest.reading_order(ingest.outside_tables(ingest.body_blocks(blocks, least=1), tables))
    return kept.select("doc", "page", "block", "column", "position")


def ingestion_report(spark, sf_dir):
    n = F.col("n_chars")
    status = F.when(n % 7 == 0, "failed").when(n % 3 == 0, "skipped").otherwise("added")
    return ingest.report(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), status.alias("status"), (n % 10).alias("chunks")))


def stage_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.round("value", 2).alias("seconds"), (F.col("event_id") % 10 > 0).alias("ok"))
    return ingest.stage_totals(rows).withColumn("seconds", F.round("seconds", 2))


def server_events(spark, sf_dir):
    """Conversations framed as event streams and decoded again."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.array(F.concat(F.lit("event: "), "role"), F.lit(": note"), F.concat(F.lit("data: "), F.col("turn").cast("string")), F.lit("data: x"), F.lit(""))).alias("k", "line"))
    lines = rows.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * 10 + F.col("k")).alias("line_no"), "line")
    return readers.server_events(lines)


def line_audit(spark, sf_dir):
    n = F.col("event_id")
    value = F.when(n % 5 == 0, F.col("props")).when(n % 5 == 1, F.lit("[1]")).when(n % 5 == 2, F.lit("{broken")).when(n % 5 == 3, F.lit(" ")).otherwise(F.lit("7"))
    return readers.line_audit(table(spark, sf_dir, "events").select(value.alias("value")))


# --- cache --------------------------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    from tamarack.functions.text import query_hash

    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(secs=F.col("doc_id").cast("decimal(18,6)"))
    n_docs = F.col("n_chars") % 3
    rows = table(spark, sf_dir, "documents").select(
        query_hash(F.col("text")).alias("query_hash"), F.col("text").alias("query"), "doc_id", n_docs.alias("n_docs"), (F.col("n_chars") % 100 / 100).alias("top_score"), at.alias("inserted_at")
    )
    return rows.withColumn("expires_at", F.col("inserted_at") + F.make_interval(secs=cache.lifetime(F.col("n_docs")).cast("decimal(18,6)")))


def cache_exact(spark, sf_dir):
    """The same documents in upper case, padded, against live entries an hour after the first."""
    live = cache.alive(_entries(spark, sf_dir), F.to_timestamp(F.lit("2024-01-01 00:10:00")))
    asked = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("query_id"), F.concat(F.lit(" "), F.translate("text", ascii_lowercase, ascii_uppercase), F.lit(" ")).alias("query"))
    return cache.exact(asked, live).select("query_id", "doc_id")


def cache_semantic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x + F.lit(0.01)).alias("embedding"))
    return cache.nearest(near, vectors, 0.9).withColumn("score", F.round("score", 6))


def cache_admission(spark, sf_dir):
    rows = _entries(spark, sf_dir).select(cache.admission(F.col("n_docs"), F.col("top_score")).alias("tier"), cache.lifetime(F.col("n_docs")).alias("ttl"))
    return rows.groupBy("tier", "ttl").agg(F.count("*").alias("n"))


def cache_evict(spark, sf_dir):
    entries = _entries(spark, sf_dir).groupBy("query_hash").agg(F.min("inserted_at").alias("inserted_at"), F.min("doc_id").alias("doc_id"), F.max("n_docs").alias("n_docs"))
    return cache.evict(entries.drop("n_docs"), entries.where("n_docs > 0"), capacity=500).select("doc_id")


# --- SQL pass-through ---------------------------------------------------------------------------------------


def _passed(statement):
    def query(spark, sf_dir):
        names = [t for t in ("customer", "orders", "lineitem", "nation", "region", "supplier", "part") if t in statement]
        return sql_guard.run(spark, f"```sql\n{statement}\n```", {t: table(spark, sf_dir, t) for t in names})

    return query


PASSED = {
    "sql_joins": """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderstatus = 'F' GROUP BY n_name""",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey",
    "sql_semi_anti": """SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
      UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "sql_grouping": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
      GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
      round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
      FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "sql_windows": """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
      count(*) OVER (PARTITION BY o_custkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders""",
    "sql_setops": """(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)""".join(("SELECT * FROM (", ") AS u")),
    "sql_best_metric": """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS r WHERE rn = 1""",
    "sql_cte": """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT r_name, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE t > 1000000 GROUP BY r_name""",
}

QUERIES = {
    f.__name__: f
    for f in (
        cost_estimate, model_totals, turn_delta, rate_limit, daily_budget, latency_histogram, termination_reason, turn_segments, completed_turns, history_budget, compaction_prefix,
        merge_humans, display_messages, miss_streak, last_n, tool_pairing, evidence_ledger, unseen_evidence, message_log_merge, progress_states, changed_files, chunk_upsert, insert_or_ignore,
        batch_cut, row_to_text, page_runs, split_text, page_plans, pdf_route, parse_quality, block_layout, ingestion_report, stage_totals, server_events, line_audit,
        cache_exact, cache_semantic, cache_admission, cache_evict,
    )
} | {name: _passed(statement) for name, statement in PASSED.items()}

ORACLES = {
    "cost_estimate": f"WITH {PRICED_CTE} SELECT n AS request_id, canonical, tariff, status, miss AS cache_miss_tokens, CASE WHEN status = 'priced' THEN round(amount::DOUBLE, 9) END AS amount FROM p",
    "model_totals": f"""WITH {PRICED_CTE} SELECT model, count(*) AS calls, sum(hit)::BIGINT AS hit_tokens, sum(miss)::BIGINT AS miss_tokens, sum(o)::BIGINT AS completion_tokens,
      round(sum(CASE WHEN status = 'priced' THEN amount::DOUBLE END), 6) AS amount, count_if(status <> 'priced') AS unpriced FROM p GROUP BY model""",
    "turn_delta": """SELECT user_id AS thread, event_id AS turn, greatest(0, CAST(floor(value) AS BIGINT) - coalesce(lag(CAST(floor(value) AS BIGINT)) OVER w, 0)) AS tools_delta,
      event_id * 2 - coalesce(lag(event_id * 2) OVER w, 0) AS tokens_delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "rate_limit": """SELECT event_id AS request_id, user_id % 20 AS bucket, row_number() OVER w AS position, row_number() OVER w > 1 AS rejected FROM events
      WINDOW w AS (PARTITION BY user_id % 20, date_trunc('minute', ts) ORDER BY ts, event_id)""",
    "daily_budget": """WITH u AS (SELECT event_id, coalesce(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id % 20, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM events)
      SELECT event_id AS request_id, b AS used_before, b >= 500 AS refused FROM u""",
    "latency_histogram": """SELECT event_type, i AS bound_no, count_if(value <= b) AS n_le FROM events, (VALUES (0, 10.0), (1, 50.0), (2, 100.0), (3, 500.0), (4, 1e300)) AS t(i, b) GROUP BY ALL""",
    "termination_reason": """SELECT CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 5 >= 3 AND event_id % 2 = 0 THEN 'rag_call_budget_exhausted' WHEN event_id % 11 >= 8 THEN 'model_round_budget_exhausted'
      WHEN event_id % 7 >= 5 THEN 'tool_batch_budget_exhausted' ELSE 'none' END AS reason, count(*) AS n, sum(7 + event_id % 11 + 3 * (event_id % 7))::BIGINT AS recursion,
      sum(least(60, event_id % 100 - 10 - event_id % 3))::BIGINT AS inputs FROM events GROUP BY ALL""",
    "turn_segments": f"WITH {TURNS_CTE} SELECT thread_id, idx, turn FROM t",
    "completed_turns": f"WITH {TURNS_CTE} SELECT thread_id, idx, turn FROM t QUALIFY turn < max(turn) OVER (PARTITION BY thread_id)",
    "history_budget": f"""WITH {TURNS_CTE} SELECT thread_id, turn, tokens, row_number() OVER w = 1 OR sum(tokens) OVER w <= 600 AS kept FROM z WINDOW w AS (PARTITION BY thread_id ORDER BY turn DESC)""",
    "compaction_prefix": f"""WITH {TURNS_CTE} SELECT thread_id, turn, tokens, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) > 1 AND sum(tokens) OVER (PARTITION BY thread_id ORDER BY turn) <= 400 AS compact FROM z""",
    "merge_humans": f"""WITH {TURNS_CTE}, r AS (SELECT *, sum(CASE WHEN type = 'human' AND prev = 'human' THEN 0 ELSE 1 END) OVER (PARTITION BY thread_id ORDER BY idx) AS run
        FROM (SELECT *, lag(type) OVER (PARTITION BY thread_id ORDER BY idx) AS prev FROM m))
      SELECT thread_id, min(idx) AS idx, min(type) AS type, md5(string_agg(text, chr(10) || chr(10) ORDER BY idx)) AS digest, count(*) AS n FROM r GROUP BY thread_id, run""",
    "display_messages": """SELECT conv_id AS thread_id, turn AS idx, role, length(trim(text, '@BLANK@')) AS chars FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, ''), '@BLANK@') <> ''""",
    "miss_streak": """WITH c AS (SELECT user_id, event_id, event_id % 4 = 0 AS h FROM events WHERE event_type <> 'error'), l AS (SELECT user_id, coalesce(max(CASE WHEN h THEN event_id END), -1) AS x FROM c GROUP BY ALL)
      SELECT user_id AS thread_id, count_if(NOT h AND event_id > x) AS misses FROM c JOIN l USING (user_id) GROUP BY ALL""",
    "last_n": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "tool_pairing": """WITH e AS (SELECT user_id, event_id, event_type <> 'signup' AS called, CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS r, event_id % 11 = 0 AS odd FROM events)
      SELECT user_id AS thread_id, event_id AS call_id, CASE WHEN called THEN 1 ELSE 0 END AS n_calls, r AS n_results,
      CASE WHEN NOT called THEN 'orphan' WHEN r = 0 THEN 'missing' WHEN r > 1 THEN 'duplicate' WHEN odd THEN 'mismatch' ELSE 'paired' END AS state FROM e WHERE called OR r > 0""",
    "evidence_ledger": """WITH i AS (SELECT user_id AS thread_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 9) ELSE event_type || '#' || (event_id % 2) END AS key, event_type AS source, event_id % 2 AS page, 'q' || (event_id % 6) AS q FROM events),
      f AS (SELECT thread_id, key, q, min(seq) AS first FROM i GROUP BY ALL), g AS (SELECT thread_id, key, list(q ORDER BY first) AS qs FROM f GROUP BY ALL),
      a AS (SELECT thread_id, key, max(seq) AS seq, arg_max(source, seq) AS source, arg_max(page, seq) AS page FROM i GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC, key) AS rn, count(*) OVER (PARTITION BY thread_id) AS n FROM a)
      SELECT thread_id, key, source, page, seq, array_to_string(qs[1:3], ',') AS queries, greatest(0, n - 4) AS omitted FROM r JOIN g USING (thread_id, key) WHERE rn <= 4""",
    "unseen_evidence": """SELECT user_id AS thread_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events v WHERE v.event_id % 9 = 0 AND v.user_id = e.user_id AND v.event_type = e.event_type) GROUP BY user_id""",
    "message_log_merge": "SELECT user_id % 50 AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 4), event_id) AS value FROM events GROUP BY ALL",
    "progress_states": "SELECT user_id AS request_id, event_id AS seq, event_type AS state FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type",
    "changed_files": "SELECT 'd/' || source || '/' || doc_id || '.txt' AS path, md5(text) AS hash FROM documents WHERE n_chars <= 300 OR n_chars > 3000",
    "chunk_upsert": """WITH n AS (SELECT doc_id + 100 AS doc_id, md5(source) AS digest, 2 AS version FROM documents WHERE lang = 'fr')
      SELECT doc_id, md5(text) AS digest, 1 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""",
    "insert_or_ignore": """WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) = 1)
      SELECT * FROM r WHERE NOT (l_returnflag = 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))""",
    "batch_cut": """WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 50 AS BIGINT) AS batch FROM lineitem)
      SELECT *, max(batch) OVER (PARTITION BY l_suppkey, l_orderkey) AS done_batch FROM b""",
    "row_to_text": """SELECT c_custkey, 'c_name：' || c_name || '；c_nationkey：' || c_nationkey || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '；c_mktsegment：' || c_mktsegment END AS content FROM customer""",
    "page_runs": """WITH l AS (SELECT l_orderkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c, CAST(floor(l_quantity / 20) AS BIGINT) AS page, l_returnflag FROM lineitem),
      p AS (SELECT *, row_number() OVER w AS k, lag(page) OVER w AS before FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY c)),
      r AS (SELECT *, sum(CASE WHEN k > 1 AND page = before THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY k)::BIGINT AS run FROM p)
      SELECT l_orderkey AS source_file, run, min(page) AS page, string_agg(l_returnflag, chr(10) || chr(10) ORDER BY k) AS page_text, count(*) AS n FROM r GROUP BY l_orderkey, run""",
    "page_plans": """SELECT p_partkey, CAST(ceil(p_size / 3.0) AS INT) AS segments, p_size AS last_page, array_to_string(list_sort(list_distinct(list_transform(range(0, least(5, p_size)),
      lambda i: CASE WHEN least(5, p_size) = 1 THEN 0 ELSE CAST(round_even(i * (p_size - 1) / (least(5, p_size) - 1), 0) AS INT) END))), ',') AS sampled FROM part""",
    "pdf_route": """WITH r AS (SELECT l_extendedprice >= 50000 AS a, l_quantity * 4 < 40 AS b, l_discount * 5 >= 0.4 AS c, l_tax * 5 >= 0.35 AS d FROM lineitem)
      SELECT CASE WHEN a OR b OR c OR d THEN 'remote' ELSE 'local' END AS parser, CASE WHEN NOT (a OR b OR c OR d) THEN 'disabled' WHEN b AND c THEN 'force' ELSE 'auto' END AS ocr,
      array_to_string(list_filter([CASE WHEN a THEN 'heavy_pages' END, CASE WHEN b THEN 'little_text' END, CASE WHEN c THEN 'large_images' END, CASE WHEN d THEN 'numeric_tables' END], lambda x: x IS NOT NULL), ';') AS reasons, count(*) AS n FROM r GROUP BY ALL""",
    "parse_quality": """WITH f AS (SELECT source, CAST(trunc(count(*) / 4) AS INT) AS pages FROM documents GROUP BY source), c AS (SELECT source, CASE WHEN n_chars % 10 > 0 THEN doc_id % 30 END AS page, text FROM documents),
      s AS (SELECT source, pages, count(*) AS n, count(DISTINCT CASE WHEN page BETWEEN 1 AND pages THEN page END) AS found, sum(length(text)) AS letters, sum(length(text) - length(replace(text, chr(65533), ''))) AS bad, count(page) AS traced FROM f JOIN c USING (source) GROUP BY ALL),
      q AS (SELECT source AS source_file, pages, n, round(found / greatest(pages, 1), 6) AS page_coverage, round(letters / greatest(pages, 1), 6) AS chars_per_page, round(bad / greatest(letters, 1), 6) AS replacement_ratio, round(traced / n, 6) AS traceable_ratio FROM s),
      w AS (SELECT *, array_to_string(list_filter([CASE WHEN pages >= 3 AND page_coverage < 0.65 THEN 'low_coverage' END, CASE WHEN chars_per_page < 80 THEN 'little_text' END, CASE WHEN replacement_ratio > 0.005 THEN 'garbled' END, CASE WHEN traceable_ratio < 0.95 THEN 'untraceable' END], lambda x: x IS NOT NULL), ';') AS reasons FROM q)
      SELECT *, reasons = '' AS acceptable FROM w""",
    "block_layout": """WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS block, l_quantity * 10 AS x0, l_discount AS d, l_quantity * 10 + 80 AS x1, l_tax * 10000 AS y0, l_tax * 10000 + 20 AS y1 FROM lineitem),
      t AS (SELECT doc, page, x0 + 10 AS x0, y0, x1, y1 - 5 AS y1 FROM b WHERE d > 0.05), k AS (SELECT * FROM b WHERE y0 >= 0.07 * 800 AND y1 <= (1 - 0.07) * 800),
      i AS (SELECT DISTINCT k.doc, k.page, k.block FROM k JOIN t ON k.doc = t.doc AND k.page = t.page WHERE greatest(0, least(k.x1, t.x1) - greatest(k.x0, t.x0)) * greatest(0, least(k.y1, t.y1) - greatest(k.y0, t.y0)) / greatest(1e-9, (k.x1 - k.x0) * (k.y1 - k.y0)) >= 0.4),
      r AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc = k.doc AND i.page = k.page AND i.block = k.block)),
      s AS (SELECT *, x1 <= 600.0 / 2 * 1.1 AS l, max(CASE WHEN x1 <= 600.0 / 2 * 1.1 THEN x1 END) OVER w AS inn, min(CASE WHEN NOT (x1 <= 600.0 / 2 * 1.1) THEN x0 END) OVER w AS outr FROM r WINDOW w AS (PARTITION BY doc, page)),
      c AS (SELECT doc, page, block, y0, x0, CASE WHEN coalesce(outr - inn > 0.12 * 600, false) AND NOT l THEN 1 ELSE 0 END AS "column" FROM s)
      SELECT doc, page, block, "column", row_number() OVER (PARTITION BY doc, page ORDER BY "column", y0, x0, block) AS position FROM c""",
    "ingestion_report": """WITH r AS (SELECT CASE WHEN n_chars % 7 = 0 THEN 'failed' WHEN n_chars % 3 = 0 THEN 'skipped' ELSE 'added' END AS s, n_chars % 10 AS c FROM documents)
      SELECT count(*) AS files, count_if(s = 'added') AS added, count_if(s = 'skipped') AS skipped, count_if(s = 'failed') AS failed, sum(CASE WHEN s = 'added' THEN c ELSE 0 END)::BIGINT AS chunks FROM r""",
    "stage_totals": "SELECT event_type AS stage, round(sum(round(value, 2)), 2) AS seconds, count_if(event_id % 10 = 0) AS failures, count(*) AS n FROM events GROUP BY ALL",
    "server_events": "SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_no, role AS event, turn || chr(10) || 'x' AS data FROM conversations",
    "line_audit": "SELECT count_if(event_id % 5 <> 3) AS lines, count_if(event_id % 5 = 0) AS objects, count_if(event_id % 5 IN (1, 4)) AS not_objects, count_if(event_id % 5 = 2) AS invalid FROM events",
    "cache_exact": """WITH e AS (SELECT doc_id, trim(lower(text), '@BLANK@') AS k FROM documents WHERE TIMESTAMP '2024-01-01' + to_seconds(doc_id + CASE WHEN n_chars % 3 = 0 THEN 300 ELSE 3600 END) > TIMESTAMP '2024-01-01 00:10:00')
      SELECT d.doc_id AS query_id, e.doc_id FROM documents d JOIN e ON trim(lower(text), '@BLANK@') = k WHERE lang = 'en'""",
    "cache_semantic": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE + 0.01) AS e FROM embeddings WHERE vec_id % 100 = 0),
      s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS raw FROM q, v)
      SELECT query_id, vec_id, round(raw, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) = 1 AND raw >= 0.9""",
    "cache_admission": """SELECT CASE WHEN n_chars % 3 = 0 THEN 'exact' WHEN n_chars % 100 / 100 < 0.5 THEN 'none' ELSE 'both' END AS tier, CASE WHEN n_chars % 3 = 0 THEN 300 ELSE 3600 END AS ttl, count(*) AS n FROM documents GROUP BY ALL""",
    "cache_evict": """WITH e AS (SELECT trim(lower(text), '@BLANK@') AS k, min(doc_id) AS doc_id, max(n_chars % 3) AS m FROM documents GROUP BY ALL), l AS (SELECT * FROM e WHERE m > 0)
      SELECT doc_id FROM l QUALIFY count(*) OVER () < 500 OR row_number() OVER (ORDER BY doc_id) > 50""",
} | PASSED
