"""Evaluation and dataset queries over retrieved documents and derived records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.operators import cache, dataset, evaluate
from tamarack.plans.retrieval_queries import BM25_CTE, K, bm25_and_overlap
from tamarack.session import documents, table

# A question counts as answerable unless its text is short; the three best overlaps are its gold documents.
CASES_CTE = (
    BM25_CTE
    + """,
cs AS (SELECT item_id AS case_id, CASE WHEN length(text) < 100 THEN false WHEN length(text) < 200 THEN NULL ELSE true END AS answerable FROM benchmark),
gd AS (SELECT query_id AS case_id, doc_id FROM ov WHERE rank <= 3),
hits AS (SELECT bm.query_id AS case_id, rank, bm.doc_id, gd.doc_id IS NOT NULL AS hit FROM bm LEFT JOIN gd ON gd.case_id = bm.query_id AND gd.doc_id = bm.doc_id WHERE rank <= 5),
fo AS (SELECT case_id, count(*) AS rc, count_if(hit) AS h, count(DISTINCT CASE WHEN hit THEN doc_id END) AS m, min(CASE WHEN hit THEN rank END) AS f,
  sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY ALL),
gc AS (SELECT case_id, count(*) AS g FROM gd GROUP BY ALL),
me AS (SELECT case_id, answerable, CASE WHEN answerable = false THEN 'no_answer' WHEN g > 0 THEN 'chunk_id' ELSE 'missing' END AS mode, coalesce(rc, 0) AS rc,
  coalesce(h, 0) AS h, coalesce(m, 0) AS m, f, coalesce(dcg, 0) AS dcg, g,
  list_sum(list_transform(range(1, least(g, 5) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM cs LEFT JOIN fo USING (case_id) LEFT JOIN gc USING (case_id)),
mx AS (SELECT case_id, answerable, mode, rc, CASE WHEN mode = 'chunk_id' THEN CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END END AS hit_at_k,
  CASE WHEN mode = 'chunk_id' THEN round(h / 5, 6) END AS precision_at_k, CASE WHEN mode = 'chunk_id' THEN round(m / g, 6) END AS recall_at_k,
  CASE WHEN mode = 'chunk_id' THEN round(coalesce(1 / f, 0), 6) END AS mrr, CASE WHEN mode = 'chunk_id' THEN round(dcg / ideal, 6) END AS ndcg_at_k,
  CASE WHEN mode = 'no_answer' THEN rc = 0 END AS retrieval_abstained FROM me)
"""
)


def cases(spark, sf_dir):
    n = F.length("text")
    flag = F.when(n < 100, F.lit(False)).when(n < 200, F.lit(None)).otherwise(F.lit(True))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), flag.alias("answerable"))


def measured(spark, sf_dir):
    found, best = bm25_and_overlap(spark, sf_dir)
    retrieved = found.select(F.col("query_id").alias("case_id"), "rank", F.col("doc_id").alias("chunk_id"))
    gold = best.where("rank <= 3").select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("chunk_id"))
    return evaluate.rank_metrics(cases(spark, sf_dir), retrieved, gold, 5)


def judged(spark, sf_dir):
    """Labels and document sizes stand for answerable flags and verdicts."""
    size = F.col("n_chars") % 11
    behavior = F.when(size < 5, "supported_answer").when(size < 7, "abstention").when(size < 9, " Unsupported_Answer ").when(size < 10, "empty_response").otherwise("odd")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", "lang", F.when(F.col("quality") == 0, F.lit(False)).when(F.col("quality") == 1, F.lit(True)).alias("answerable"), behavior.alias("behavior"))


JUDGED_CTE = """
j AS (SELECT doc_id, lang, quality <> 0 AS answerable, CASE WHEN n_chars % 11 < 5 THEN 'supported_answer' WHEN n_chars % 11 < 7 THEN 'abstention'
  WHEN n_chars % 11 < 9 THEN 'unsupported_answer' WHEN n_chars % 11 < 10 THEN 'empty_response' ELSE 'judge_error' END AS b FROM documents LEFT JOIN labels USING (doc_id)),
o AS (SELECT *, coalesce(answerable, true) AS yes, CASE WHEN b IN ('empty_response', 'judge_error') THEN b
  WHEN coalesce(answerable, true) THEN CASE b WHEN 'supported_answer' THEN 'correct_answer' WHEN 'abstention' THEN 'false_refusal' ELSE 'unsupported_answer' END
  ELSE CASE b WHEN 'abstention' THEN 'correct_abstention' WHEN 'supported_answer' THEN 'negative_label_conflict' ELSE 'hallucinated_answer' END END AS outcome FROM j)
"""


def rank_metrics(spark, sf_dir):
    return measured(spark, sf_dir)


def retrieval_summary(spark, sf_dir):
    return evaluate.retrieval_summary(measured(spark, sf_dir).withColumn("retrieve_ok", F.col("case_id") != 3))


def source_page_match(spark, sf_dir):
    """Documents' sources and sizes stand for retrieved files and pages; gold labels use a path and sometimes no page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    first, second = bm25_and_overlap(spark, sf_dir)
    found = first.join(docs, "doc_id").select(F.col("query_id").alias("case_id"), "rank", F.concat(F.lit("Reports\\"), "source").alias("source_file"), (F.col("n_chars") % 4).alias("source_page"))
    labels = second.where("rank <= 3").join(docs, "doc_id")
    labels = labels.select(F.col("query_id").alias("case_id"), F.col("source").alias("source_file"), F.when(F.col("rank") > 1, F.col("n_chars") % 4).alias("page"))
    return evaluate.source_page_recall(found, labels)


def answer_outcomes(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.select("doc_id", evaluate.outcome(F.col("answerable"), F.col("behavior")).alias("outcome"))


def answer_summary(spark, sf_dir):
    return evaluate.answer_summary(judged(spark, sf_dir), ["lang"])


def summary_grouping_sets(spark, sf_dir):
    rows = judged(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("source").alias("industry")), "doc_id")
    return evaluate.by_granularity(rows.withColumn("size", F.col("n_chars").cast("double")), ["size"])


def latency_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    timings = events.select(
        "event_type", F.when(F.col("event_id") % 3 == 0, F.round(F.col("value") / 100, 4)).alias("evaluation_s"), F.round(F.col("value") / 50, 4).alias("total_s"),
        (F.col("event_type") != "error").alias("ok"),
    )
    return evaluate.latency(timings, ["event_type"])


def label_audit(spark, sf_dir):
    """Documents as evaluation records with assorted defects."""
    n = F.col("n_chars")
    record = documents(spark, sf_dir).select(
        F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("case-"), (F.col("doc_id") % 900).cast("string"))).alias("case_id"),
        F.when(n % 17 == 0, " ").otherwise(F.col("text")).alias("question"),
        F.when(n % 7 == 0, F.lit(None)).otherwise(F.lit("x")).alias("ground_truth"),
        (n % 5 != 0).alias("answerable"),
        F.when(n % 3 == 0, 2).otherwise(3).alias("schema_version"),
        F.when(n % 2 == 0, "approved").when(n % 11 == 0, F.lit(None)).otherwise("pending").alias("review_status"),
        F.when(n % 4 == 0, "passed").otherwise("needs_review").alias("validation_status"),
        F.when(n % 6 < 3, F.array("source")).otherwise(F.array().cast("array<string>")).alias("gold_chunk_ids"),
        F.when(n % 6 == 3, F.array("source")).alias("gold_sources"),
        F.when(n % 8 < 5, F.array("source")).alias("gold_evidence"),
    )
    return evaluate.label_audit(record)


def stratified_sample(spark, sf_dir):
    docs = dataset.drop_noise(documents(spark, sf_dir)).withColumn("doc_type", F.when(F.col("text").rlike(r"(?m)^\s*\|.+\|\s*$"), "table").otherwise("text"))
    return dataset.stratified_sample(docs, ["lang", "doc_type"], "source", "doc_id", 60).select("doc_id", "lang", "doc_type", "source", "turn")


def balanced_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "lang", "source")
    return dataset.balanced_subset(docs, ["lang", "source"], 100)


def adjacent_pairs(spark, sf_dir):
    """Line items of an order: part numbers as pages, line numbers as chunks."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_file"), (F.col("l_partkey") % 10).alias("page"), F.col("l_linenumber").alias("chunk_id"))
    return dataset.adjacent_pairs(rows)


def evidence_check(spark, sf_dir):
    """Questions and answers cut from documents; some quotes are too short, some out of range, some answers hold other numbers."""
    n = F.col("n_chars")
    quote = F.when(n % 3 == 0, F.substring("text", 5, 40)).when(n % 3 == 1, F.lit("abc")).otherwise(F.lit("no such quotation here"))
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"),
        F.when(n % 7 == 0, "short").otherwise(F.col("text")).alias("question"),
        F.concat(F.lit("answer "), n.cast("string")).alias("answer"),
        F.when(n % 2 == 0, "multi_chunk").otherwise("single_chunk").alias("scope"),
        F.array("text", F.concat(F.lit("size "), F.when(n % 4 < 2, n.cast("string")).otherwise(F.lit("unknown")))).alias("chunks"),
        F.array(F.struct((1 + n % 4).cast("int").alias("chunk_index"), quote.alias("quote")), F.struct(F.lit(2).alias("chunk_index"), F.lit("size  ").alias("quote"))).alias("evidence"),
    )
    found = dataset.validate_pairs(rows)
    return found.select("case_id", "accepted", F.array_join("reasons", ";").alias("reasons"))


def stratum_distribution(spark, sf_dir):
    return dataset.strata_counts(table(spark, sf_dir, "documents"), ["lang"], "source")


def duplicate_groups(spark, sf_dir):
    return dataset.duplicate_groups(table(spark, sf_dir, "documents"))


def corpus_quality(spark, sf_dir):
    return dataset.corpus_quality(documents(spark, sf_dir), "source")


def bundle_manifest(spark, sf_dir):
    n = F.col("n_chars")
    rows = judged(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "answerable", F.when(n % 3 == 0, "multi_chunk").otherwise("single_chunk").alias("reasoning_scope"),
        F.when(n % 4 == 0, F.array(F.lit("table"))).otherwise(F.array(F.lit("text"))).alias("content_types"), F.when(n % 5 == 0, "approved").otherwise("pending").alias("review_status"),
    )
    return dataset.manifest(rows)


def semantic_dedup_pairs(spark, sf_dir):
    return cache.semantic_pairs(table(spark, sf_dir, "embeddings"), 0.5, most=None).withColumn("score", F.round("score", 6))


def semantic_dedup_keep(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cache.greedy_keep(vectors, cache.semantic_pairs(vectors, 0.5, most=None))


QUERIES = {
    f.__name__: f
    for f in (
        rank_metrics, retrieval_summary, source_page_match, answer_outcomes, answer_summary, summary_grouping_sets, latency_percentiles, label_audit,
        stratified_sample, balanced_subset, adjacent_pairs, evidence_check, stratum_distribution, duplicate_groups, corpus_quality, bundle_manifest,
        semantic_dedup_pairs, semantic_dedup_keep,
    )
}

_RATE = "round(count_if(outcome = '{0}' AND {1}) / nullif(count_if(outcome <> 'judge_error' AND {1}), 0), 4)"
_SHUFFLE = "md5(concat_ws('|', '0', {0}))"

ORACLES = {
    "rank_metrics": f"""WITH {CASES_CTE} SELECT case_id, mode AS retrieval_label_mode, mode = 'chunk_id' AS retrieval_evaluable, rc AS retrieved_count,
      hit_at_k, precision_at_k, recall_at_k, mrr, ndcg_at_k, retrieval_abstained FROM mx""",
    "retrieval_summary": f"""WITH {CASES_CTE} SELECT count_if(mode = 'chunk_id') AS evaluable, count_if(mode = 'missing') AS missing_labels, count_if(mode = 'no_answer') AS no_answer,
      count_if(mode = 'no_answer' AND case_id = 3) AS no_answer_errors, round(count_if(mode = 'no_answer' AND case_id <> 3 AND rc = 0) / nullif(count_if(mode = 'no_answer' AND case_id <> 3), 0), 4) AS abstention_rate,
      round(avg(hit_at_k), 4) AS hit_at_k, round(avg(precision_at_k), 4) AS precision_at_k, round(avg(recall_at_k), 4) AS recall_at_k, round(avg(mrr), 4) AS mrr, round(avg(ndcg_at_k), 4) AS ndcg_at_k FROM mx""",
    "source_page_match": f"""WITH {BM25_CTE}, r AS (SELECT query_id AS case_id, source, n_chars % 4 AS p FROM bm JOIN documents USING (doc_id)),
      g AS (SELECT DISTINCT query_id AS case_id, source, CASE WHEN rank > 1 THEN n_chars % 4 END AS page FROM ov JOIN documents USING (doc_id) WHERE rank <= 3)
      SELECT case_id, count(*) AS gold_labels, count_if(EXISTS (SELECT 1 FROM r WHERE r.case_id = g.case_id AND r.source = g.source AND (g.page IS NULL OR r.p = g.page))) AS matched_labels,
        round(count_if(EXISTS (SELECT 1 FROM r WHERE r.case_id = g.case_id AND r.source = g.source AND (g.page IS NULL OR r.p = g.page))) / count(*), 6) AS source_page_recall FROM g GROUP BY case_id""",
    "answer_outcomes": f"WITH {JUDGED_CTE} SELECT doc_id, outcome FROM o",
    "answer_summary": f"""WITH {JUDGED_CTE} SELECT lang, count(*) AS n, count_if(outcome <> 'judge_error') AS evaluable, round(count_if(outcome <> 'judge_error') / count(*), 4) AS judge_coverage,
      count_if(yes) AS positives, count_if(NOT yes) AS negatives, count_if(outcome = 'empty_response') AS empty_responses, count_if(outcome = 'judge_error') AS judge_errors,
      round(count_if(outcome IN ('correct_answer', 'correct_abstention')) / nullif(count_if(outcome <> 'judge_error'), 0), 4) AS accuracy,
      {_RATE.format("correct_abstention", "NOT yes")} AS abstention_accuracy, {_RATE.format("hallucinated_answer", "NOT yes")} AS hallucination_rate,
      {_RATE.format("false_refusal", "yes")} AS false_refusal_rate, {_RATE.format("negative_label_conflict", "NOT yes")} AS conflict_rate FROM o GROUP BY lang""",
    "summary_grouping_sets": f"""WITH {JUDGED_CTE}, r AS (SELECT CASE WHEN yes THEN 'answerable' ELSE 'no_answer' END AS a, source, n_chars FROM o JOIN documents USING (doc_id))
      SELECT 'all' AS grain, 'all' AS value, count(*) AS n, round(avg(n_chars), 4) AS size FROM r UNION ALL
      SELECT 'answerable', a, count(*), round(avg(n_chars), 4) FROM r GROUP BY a UNION ALL
      SELECT 'industry', source, count(*), round(avg(n_chars), 4) FROM r WHERE source <> '' GROUP BY source HAVING count(*) >= 3""",
    "latency_percentiles": """WITH t AS (SELECT event_type, coalesce(CASE WHEN event_id % 3 = 0 THEN round(value / 100, 4) END, round(value / 50, 4)) * 1000 AS ms FROM events)
      SELECT event_type, count(*) AS n, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS ok_rate, round(quantile_disc(ms, 0.5), 2) AS p50_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms FROM t GROUP BY event_type""",
    "label_audit": """WITH r AS (SELECT n_chars AS n, CASE WHEN n_chars % 13 = 0 THEN '' ELSE 'case-' || (doc_id % 900) END AS c, CASE WHEN n_chars % 17 = 0 THEN '' ELSE trim(text, '@BLANK@') END AS q,
        n_chars % 5 <> 0 AS yes, n_chars % 3 <> 0 AS v3, CASE WHEN n_chars % 2 = 0 THEN 'approved' WHEN n_chars % 11 = 0 THEN 'missing' ELSE 'pending' END AS rs FROM documents),
      t AS (SELECT 'issue' AS kind, 'review_status_' || rs AS name FROM r WHERE v3 AND rs <> 'approved'
        UNION ALL SELECT 'issue', 'evidence_validation_not_passed' FROM r WHERE v3 AND yes AND n % 4 <> 0
        UNION ALL SELECT 'issue', 'missing_gold_evidence' FROM r WHERE v3 AND yes AND n % 8 >= 5
        UNION ALL SELECT 'issue', 'no_answer_validation_state_invalid' FROM r WHERE v3 AND NOT yes AND n % 4 = 0
        UNION ALL SELECT 'issue', 'missing_question' FROM r WHERE q = ''
        UNION ALL SELECT 'issue', 'missing_reference_answer' FROM r WHERE yes AND n % 7 = 0
        UNION ALL SELECT 'issue', 'missing_case_id' FROM r WHERE c = ''
        UNION ALL SELECT 'issue', 'source_page_fallback_only' FROM r WHERE yes AND n % 6 = 3
        UNION ALL SELECT 'issue', 'missing_retrieval_labels' FROM r WHERE yes AND n % 6 > 3
        UNION ALL SELECT 'mode', CASE WHEN NOT yes THEN 'no_answer_records' WHEN n % 6 < 3 THEN 'chunk_id_labelled' WHEN n % 6 = 3 THEN 'source_page_fallback' ELSE 'unlabelled' END FROM r
        UNION ALL SELECT 'review', rs FROM r WHERE v3)
      SELECT kind, name, count(*) AS n FROM t GROUP BY ALL
      UNION ALL SELECT 'issue', 'duplicate_case_id', sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM r WHERE c <> '' GROUP BY c) HAVING sum(k - 1) > 0
      UNION ALL SELECT 'issue', 'duplicate_question', sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM r WHERE q <> '' GROUP BY q) HAVING sum(k - 1) > 0""",
    "stratified_sample": f"""WITH d AS (SELECT doc_id, lang, source, CASE WHEN regexp_matches(text, '(?m)^\\s*\\|.+\\|\\s*$') THEN 'table' ELSE 'text' END AS doc_type FROM documents
        WHERE length(trim(text, '@BLANK@')) >= 100 AND NOT regexp_matches(substr(text, 1, 600), '免责声明|分析师声明|评级说明|执业编号|证券投资咨询业务资格')),
      h AS (SELECT *, {_SHUFFLE.format("CAST(doc_id AS VARCHAR)")} AS h, {_SHUFFLE.format("source")} AS s, {_SHUFFLE.format("lang, doc_type")} AS g FROM d),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang, doc_type, source ORDER BY h, doc_id) AS round FROM h),
      t AS (SELECT *, row_number() OVER (PARTITION BY lang, doc_type ORDER BY round, s, source) AS turn FROM r)
      SELECT doc_id, lang, doc_type, source, turn FROM t ORDER BY turn, g, lang, doc_type, doc_id LIMIT 60""",
    "balanced_subset": f"""WITH r AS (SELECT doc_id AS case_id, lang, source, {_SHUFFLE.format("lang, source")} AS g,
        row_number() OVER (PARTITION BY lang, source ORDER BY {_SHUFFLE.format("CAST(doc_id AS VARCHAR)")}, doc_id) AS turn FROM documents)
      SELECT case_id, lang, source, turn FROM r ORDER BY turn, g, lang, source, case_id LIMIT 100""",
    "adjacent_pairs": """WITH r AS (SELECT l_orderkey AS source_file, l_partkey % 10 AS page, l_linenumber AS c FROM lineitem),
      n AS (SELECT source_file, page, c, lead(c) OVER w AS nc, lead(page) OVER w AS np FROM r WINDOW w AS (PARTITION BY source_file ORDER BY page, c))
      SELECT DISTINCT source_file, least(c, nc) AS a, greatest(c, nc) AS b FROM n WHERE nc IS NOT NULL AND abs(np - page) <= 1""",
    "evidence_check": r"""WITH r AS (SELECT doc_id, n_chars AS n, text, CASE WHEN n_chars % 7 = 0 THEN 'short' ELSE trim(text, '@BLANK@') END AS q,
        lower(regexp_replace(text, '[\s,，]', '', 'g')) AS c1, 'size' || CASE WHEN n_chars % 4 < 2 THEN n_chars::VARCHAR ELSE 'unknown' END AS c2,
        1 + n_chars % 4 AS ix, lower(regexp_replace(CASE n_chars % 3 WHEN 0 THEN substr(text, 5, 40) WHEN 1 THEN 'abc' ELSE 'no such quotation here' END, '[\s,，]', '', 'g')) AS quote FROM documents),
      x AS (SELECT *, list_filter([CASE WHEN length(q) < 6 THEN 'question_too_short' END,
        CASE WHEN ix > 2 THEN 'invalid_evidence_chunk_index' WHEN length(quote) < 6 THEN 'evidence_too_short' WHEN NOT contains(CASE ix WHEN 1 THEN c1 ELSE c2 END, quote) THEN 'evidence_quote_not_found' END,
        'evidence_too_short', CASE WHEN n % 2 = 0 THEN 'multi_chunk_evidence_incomplete' END,
        CASE WHEN NOT contains(c1 || c2, n::VARCHAR) THEN 'unsupported_answer_numbers:' || n END], lambda v: v IS NOT NULL) AS l FROM r)
      SELECT doc_id AS case_id, len(l) = 0 AS accepted, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ';') AS reasons FROM x""",
    "stratum_distribution": "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang",
    "duplicate_groups": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    "corpus_quality": r"""SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS replacements,
      count_if(regexp_matches(text, '(?m)^\s*\|.+\|\s*$')) AS tables, count_if(length(trim(text, '@BLANK@')) < 100) AS short FROM documents GROUP BY source""",
    "bundle_manifest": f"""WITH {JUDGED_CTE} SELECT count(*) AS records, count_if(yes) AS answerable, count_if(NOT yes) AS no_answer, count_if(n_chars % 3 = 0) AS multi_chunk,
      count_if(n_chars % 4 = 0) AS table_cases, count_if(n_chars % 5 <> 0) AS pending_review FROM o JOIN documents USING (doc_id)""",
    "semantic_dedup_pairs": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
      SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 9) >= 0.5""",
}
