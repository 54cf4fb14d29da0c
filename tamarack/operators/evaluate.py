"""Evaluation: ranking metrics, answer outcomes, summaries, percentiles, label audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import base_name, same_source, strip
from tamarack.session import written

METRICS = ["hit_at_k", "precision_at_k", "recall_at_k", "mrr", "ndcg_at_k", "source_page_recall"]
BEHAVIORS = ["supported_answer", "abstention", "unsupported_answer", "empty_response", "judge_error"]


def is_answerable(flag: Column) -> Column:
    """Null and missing count as answerable."""
    return ~flag.eqNullSafe(F.lit(False))


def mean(value: Column) -> Column:
    return F.round(F.avg(value), 4)


def share(condition: Column, among: Column | None = None) -> Column:
    """Share of rows, among those of the second condition if given; null without any."""
    value = condition.cast("double")
    return mean(value if among is None else F.when(among, value))


def gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank.cast("double") + 1)


def ideal_gain(hits: Column) -> Column:
    return F.when(hits > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), gain), F.lit(0.0), lambda acc, v: acc + v))


def rank_metrics(cases: DataFrame, retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row per case: label mode and metrics of the first k.

    cases: case_id, answerable. retrieved: case_id, rank, chunk_id. gold: case_id,
    chunk_id, distinct. Precision divides by k; a repeated gold chunk counts again
    in precision and gain but once in recall.
    """
    first = retrieved.where(F.col("rank") <= k).join(gold.withColumn("hit", F.lit(1)), ["case_id", "chunk_id"], "left")
    found = first.groupBy("case_id").agg(
        F.count("*").alias("retrieved_count"),
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"),
        F.count_distinct(F.when(F.col("hit") == 1, F.col("chunk_id"))).alias("matched"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit") == 1, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    labels = gold.groupBy("case_id").agg(F.count("*").alias("gold_label_count"))
    rows = cases.join(found, "case_id", "left").join(labels, "case_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    mode = F.when(~is_answerable(F.col("answerable")), "no_answer").when(count("gold_label_count") > 0, "chunk_id").otherwise("missing")
    rows = rows.withColumn("mode", mode)
    only = lambda value: F.when(F.col("mode") == "chunk_id", F.round(value, 6))
    return rows.select(
        "case_id",
        F.col("mode").alias("retrieval_label_mode"),
        (F.col("mode") == "chunk_id").alias("retrieval_evaluable"),
        count("retrieved_count").alias("retrieved_count"),
        only(F.when(count("hits") > 0, 1.0).otherwise(0.0)).alias("hit_at_k"),
        only(count("hits") / k).alias("precision_at_k"),
        only(count("matched") / F.col("gold_label_count")).alias("recall_at_k"),
        only(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        only(F.coalesce("dcg", F.lit(0.0)) / ideal_gain(F.least(F.col("gold_label_count"), F.lit(k)).cast("int"))).alias("ndcg_at_k"),
        F.when(F.col("mode") == "no_answer", count("retrieved_count") == 0).alias("retrieval_abstained"),
    )


def source_page_hits(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Retrieved rows that meet a gold (source, page): equal or path-suffix sources, pages equal or the gold page null.

    An equi-join on the base name, which any two such sources share, with the suffix test on top.
    """
    left = retrieved.withColumn("_name", base_name(F.col("source_file")))
    right = gold.select("case_id", F.col("source_file").alias("gold_source"), F.col("page").alias("gold_page"))
    right = right.withColumn("_name", base_name(F.col("gold_source")))
    met = left.join(right, ["case_id", "_name"])
    fits = same_source(F.col("source_file"), F.col("gold_source")) & (F.col("gold_page").isNull() | (F.col("gold_page") == F.col("source_page")))
    return met.where(fits).drop("_name")


def source_page_recall(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, gold_labels, matched_labels, source_page_recall."""
    labels = gold.select("case_id", "source_file", "page").distinct()
    hits = source_page_hits(retrieved, labels).select("case_id", "gold_source", "gold_page").distinct().groupBy("case_id").agg(F.count("*").alias("matched_labels"))
    totals = labels.groupBy("case_id").agg(F.count("*").alias("gold_labels")).join(hits, "case_id", "left")
    matched = F.coalesce("matched_labels", F.lit(0))
    return totals.select("case_id", "gold_labels", matched.alias("matched_labels"), F.round(matched / F.col("gold_labels"), 6).alias("source_page_recall"))


def outcome(answerable: Column, behavior: Column) -> Column:
    """The answerability matrix; unknown behaviours are judge errors."""
    known = F.lower(strip(F.coalesce(behavior, F.lit("judge_error"))))
    known = F.when(known.isin(BEHAVIORS), known).otherwise("judge_error")
    yes = is_answerable(answerable)
    return (
        F.when(known.isin("empty_response", "judge_error"), known)
        .when(yes & (known == "supported_answer"), "correct_answer")
        .when(yes & (known == "abstention"), "false_refusal")
        .when(yes, "unsupported_answer")
        .when(known == "abstention", "correct_abstention")
        .when(known == "supported_answer", "negative_label_conflict")
        .otherwise("hallucinated_answer")
    )


def answer_summary(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(answerable, behavior) -> counts and rates; judge errors stay out of the rates."""
    what = outcome(F.col("answerable"), F.col("behavior"))
    yes, able = is_answerable(F.col("answerable")), what != "judge_error"
    return judged.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.count_if(able).alias("evaluable"),
        share(able).alias("judge_coverage"),
        F.count_if(yes).alias("positives"),
        F.count_if(~yes).alias("negatives"),
        F.count_if(what == "empty_response").alias("empty_responses"),
        F.count_if(what == "judge_error").alias("judge_errors"),
        share(what.isin("correct_answer", "correct_abstention"), able).alias("accuracy"),
        share(what == "correct_abstention", able & ~yes).alias("abstention_accuracy"),
        share(what == "hallucinated_answer", able & ~yes).alias("hallucination_rate"),
        share(what == "false_refusal", able & yes).alias("false_refusal_rate"),
        share(what == "negative_label_conflict", able & ~yes).alias("conflict_rate"),
    )


def retrieval_summary(measured: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of rank_metrics with retrieve_ok -> counts and mean metrics; failed retrievals are no abstentions."""
    none = F.col("retrieval_label_mode") == "no_answer"
    done = none & ~F.col("retrieve_ok").eqNullSafe(F.lit(False))
    present = [m for m in METRICS if m in measured.columns]
    return measured.groupBy(*(keys or [])).agg(
        F.count_if("retrieval_evaluable").alias("evaluable"),
        F.count_if(F.col("retrieval_label_mode") == "missing").alias("missing_labels"),
        F.count_if(none).alias("no_answer"),
        F.count_if(none & ~done).alias("no_answer_errors"),
        share(F.coalesce("retrieval_abstained", F.lit(False)), done).alias("abstention_rate"),
        *(mean(F.col(m)).alias(m) for m in present),
    )


def by_granularity(rows: DataFrame, metrics: list[str], least: int = 3) -> DataFrame:
    """Means over everything, by answerable or not, and by non-blank industry with `least` rows, in one pass.

    (answerable, industry, metrics) -> grain, value, n, metrics.
    """
    plain = rows.select(
        F.when(is_answerable(F.col("answerable")), "answerable").otherwise("no_answer").alias("answer_group"),
        strip(F.coalesce("industry", F.lit(""))).alias("industry"),
        *metrics,
    )
    sets = plain.groupingSets([[], ["answer_group"], ["industry"]], "answer_group", "industry").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), *(mean(F.col(m)).alias(m) for m in metrics)
    )
    grain = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "answerable").otherwise("industry")
    named = sets.withColumn("grain", grain)
    kept = (F.col("grain") != "industry") | ((F.col("n") >= least) & (F.col("industry") != ""))
    return named.where(kept).select("grain", F.coalesce("answer_group", "industry", F.lit("all")).alias("value"), "n", *metrics)


def latency(timings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(total_s, evaluation_s, ok) -> ok_rate and nearest-rank percentiles in milliseconds."""
    ms = F.coalesce("evaluation_s", "total_s") * 1000
    rank = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _ms)"), 2)
    return timings.withColumn("_ms", ms).groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), mean(F.col("ok").cast("double")).alias("ok_rate"), rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms")
    )


def label_audit(records: DataFrame) -> DataFrame:
    """Issues and label modes of evaluation records: kind, name, n; zero counts have no row.

    records: case_id, question, ground_truth, answerable, schema_version,
    review_status, validation_status, gold_chunk_ids, gold_sources, gold_evidence.
    """
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    yes = is_answerable(F.col("answerable"))
    v3 = F.coalesce("schema_version", F.lit(0)) >= 3
    review = F.coalesce(F.nullif(strip(F.col("review_status")), F.lit("")), F.lit("missing"))
    passed = F.coalesce("validation_status", F.lit("")) == "passed"
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    chunks, sources = some("gold_chunk_ids"), some("gold_sources")
    issues = F.array(
        F.when(v3 & (review != "approved"), F.concat(F.lit("review_status_"), review)),
        F.when(v3 & yes & ~passed, F.lit("evidence_validation_not_passed")),
        F.when(v3 & yes & ~some("gold_evidence"), F.lit("missing_gold_evidence")),
        F.when(v3 & ~yes & (F.coalesce("validation_status", F.lit("")) != "needs_review"), F.lit("no_answer_validation_state_invalid")),
        F.when(text("question") == "", F.lit("missing_question")),
        F.when(yes & (text("ground_truth") == ""), F.lit("missing_reference_answer")),
        F.when(text("case_id") == "", F.lit("missing_case_id")),
        F.when(yes & ~chunks & sources, F.lit("source_page_fallback_only")),
        F.when(yes & ~chunks & ~sources, F.lit("missing_retrieval_labels")),
    )
    mode = F.when(~yes, "no_answer_records").when(chunks, "chunk_id_labelled").when(sources, "source_page_fallback").otherwise("unlabelled")
    tags = F.concat(
        F.transform(F.filter(issues, F.isnotnull), lambda i: F.struct(F.lit("issue").alias("kind"), i.alias("name"))),
        F.array(F.struct(F.lit("mode").alias("kind"), mode.alias("name"))),
        F.when(v3, F.array(F.struct(F.lit("review").alias("kind"), review.alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
    )
    counted = records.select(F.explode(tags).alias("t")).groupBy("t.kind", "t.name").agg(F.count("*").alias("n"))

    def repeats(column: str) -> DataFrame:
        found = records.where(text(column) != "").groupBy(text(column).alias("v")).agg(F.count("*").alias("c")).where("c > 1")
        return found.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(
            F.lit("issue").alias("kind"), F.lit("duplicate_" + column).alias("name"), "n"
        ).where("n > 0")

    return counted.unionByName(repeats("case_id")).unionByName(repeats("question"))


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each value, the commonest first, ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def metric_block(rows: DataFrame, keys: list[str], means: list[str], k: int) -> DataFrame:
    """Per group: cases, the share that is evaluable, and the means of the named metrics, as columns named metric@k."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.col("retrieval_evaluable")).alias("evaluable_share"), *(mean(F.col(m)).alias(f"{m.removesuffix('_at_k')}@{k}") for m in means)
    )


def run(cases: DataFrame, retrieved: DataFrame, gold: DataFrame, judged: DataFrame | None, path: str, k: int = 5, ok: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """One evaluation run: details as CSV, sorted over as many files as there are tasks, and the summary as one JSON object under `path`; gives the summary, one row.

    judged (case_id, answerable, behavior) are the answers' verdicts; without
    them only retrieval is summed up. ok (case_id, retrieve_ok) tells which
    retrievals worked: a case that it lacks failed; without it all worked. `more` are columns by case_id that go with the details and, if they are metrics, into the summary.
    """
    measured = rank_metrics(cases, retrieved, gold, k)
    worked = F.coalesce("retrieve_ok", F.lit(False))
    measured = measured.withColumn("retrieve_ok", F.lit(True)) if ok is None else measured.join(ok.select("case_id", "retrieve_ok"), "case_id", "left").withColumn("retrieve_ok", worked)
    if more is not None:
        measured = measured.join(more, "case_id", "left")
    if judged is not None:
        measured = measured.join(judged.select("case_id", outcome(F.col("answerable"), F.col("behavior")).alias("outcome")), "case_id", "left")
    details = written(measured, "evaluation")
    details.orderBy("case_id").write.mode("overwrite").option("header", True).csv(f"{path}/details")
    summary = retrieval_summary(details).select(F.lit(k).alias("k"), F.struct("*").alias("retrieval"))
    if judged is not None:
        summary = summary.crossJoin(answer_summary(judged).select(F.struct("*").alias("answers")))  # a row each
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary
