"""Command entries: ingest a folder, audit a set of evaluation records, build one, run one.

``python -m tamarack ingest|audit|generate|evaluate --help``. Paths are any that
Spark reads. Questions, verdicts and scores of models come from files or, in code, from injected functions.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import case_id, strip
from tamarack.operators import build, dataset, evaluate, retrieval
from tamarack.operators import search as searching
from tamarack.session import create_session, discard, written
from tamarack.sources import readers
from tamarack.sources.writers import Manifest, write_bundle

DRAFTS = "unit string, question string, answer string, answerable boolean, category string, evidence array<struct<chunk_index:int,quote:string>>"
VERDICTS = "case_id string, behavior string"
#: Groups from which the small sets of a bundle take their cases in turn.
BUCKETS = ["answerable", "reasoning_scope", "industry"]


def ingest(spark: SparkSession, folder: str, store: str) -> dict:
    """One run over `folder` into the store and its manifest under `store`."""
    return build.ingest(spark, folder, build.chunk_store(spark, f"{store}/chunks"), Manifest(spark, f"{store}/manifest"))


def audit(spark: SparkSession, path: str) -> dict:
    """Counts of a set's labels, states and issues; lines that are no JSON object are an issue."""
    lines = spark.read.text(path)
    shape = readers.line_audit(lines).first()
    # Every object, whatever its question: what the reader of an evaluation drops is what an audit is for.
    objects = lines.where(strip(F.col("value")).startswith("{") & F.expr("try_parse_json(value)").isNotNull())
    record = objects.select(F.from_json("value", readers.EVAL_RECORDS + ", reference_answer string").alias("r")).select("r.*")
    reference = F.coalesce(F.nullif("ground_truth", F.lit("")), F.col("reference_answer"))
    rows = written(record.withColumns({"ground_truth": reference, "validation_status": F.col("evidence_validation.status")}), "audited")
    found = evaluate.label_audit(rows).orderBy("name").collect()  # names of issues, modes and states
    of = lambda kind: {r.name: r.n for r in found if r.kind == kind}
    modes, issues = of("mode"), of("issue")
    passed = rows.where(evaluate.is_answerable(F.col("answerable")) & (F.coalesce("schema_version", F.lit(0)) >= 3) & (F.col("validation_status") == "passed")).count()
    total = rows.count()
    discard([rows])
    broken = shape.invalid + shape.not_objects
    return {
        "total_records": total, **{m: modes.get(m, 0) for m in ("chunk_id_labelled", "source_page_fallback", "no_answer_records")},
        "evidence_validated": passed, "review_statuses": of("review"), "issues": issues | ({"invalid_json": broken} if broken else {}),
    }


def units(spark: SparkSession, store: str, size: int = 150, ratio: float = 0.25, seed: str = "42") -> DataFrame:
    """unit, scope, source_file, industry, chunks (array of chunk_id, page, content, table): what questions are to be written about."""
    chunks = dataset.drop_noise(build.chunk_store(spark, f"{store}/chunks").read(), "content")
    kinds = {"industry": F.coalesce("industry", F.lit("")), "table": F.col("content").rlike(r"(?m)^\s*\|.+\|\s*$")}
    sampled = written(dataset.stratified_sample(chunks.withColumns(kinds), ["industry", "table"], "source_file", "chunk_id", size, seed), "sampled")
    placed = dataset.evidence_units(sampled, dataset.adjacent_pairs(sampled), ratio, seed)
    met = placed.join(sampled, ["source_file", "chunk_id"])
    return met.groupBy("source_file", "unit", "scope").agg(F.min("industry").alias("industry"), F.array_sort(F.collect_list(F.struct("chunk_id", "page", "content", "table"))).alias("chunks"))


def records(made: DataFrame, drafts: DataFrame, no_answer: int = 20, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """Evaluation records of the drafts that hold, and the reasons against the others with their numbers.

    made as :func:`units` gives it; drafts in the columns of DRAFTS. A draft
    with an answer names its unit and quotes its chunks; one without an answer
    needs a question only, and a seeded choice of `no_answer` of them stays. Of
    several with one question the first by answer counts. All wait for a review.
    """
    rows = drafts.withColumns({"question": strip(F.coalesce("question", F.lit(""))), "answer": strip(F.coalesce("answer", F.lit("")))})
    yes = evaluate.is_answerable(F.col("answerable"))
    none = F.array().cast("array<struct<chunk_index:int,quote:string>>")
    first_of = F.row_number().over(Window.partitionBy("case_id").orderBy("answer", "category", F.to_json("evidence")))
    pairs = rows.where(yes).join(made, "unit").withColumns({"case_id": case_id(F.col("chunks.chunk_id"), F.col("question")), "evidence": F.coalesce("evidence", none)}).withColumn("_n", first_of).where("_n = 1")
    pairs = written(pairs, "drafts")
    checked = dataset.validate_pairs(pairs.select("case_id", "question", "answer", "scope", F.col("chunks.content").alias("chunks"), "evidence"))
    held = pairs.join(checked.where("accepted").select("case_id"), "case_id", "left_semi")
    quoted = F.transform("evidence", lambda e: F.struct(F.get("chunks.chunk_id", e["chunk_index"] - 1).alias("chunk_id"), e["quote"].alias("quote")))
    first = F.element_at("chunks", 1)
    answered = held.select(
        F.lit(3).alias("schema_version"), "case_id", "question", F.col("answer").alias("ground_truth"), F.lit(True).alias("answerable"), F.col("chunks.chunk_id").alias("gold_chunk_ids"),
        "source_file", first["page"].alias("page"), "industry", "category", F.col("scope").alias("reasoning_scope"),
        F.when(F.exists("chunks", lambda c: c["table"]), F.array(F.lit("table"))).otherwise(F.array(F.lit("text"))).alias("content_types"), quoted.alias("gold_evidence"),
        F.struct(F.lit("passed").alias("status")).alias("evidence_validation"), F.lit("pending").alias("review_status"),
    )
    open_ones = rows.where(~yes & (F.length("question") > 0)).withColumn("case_id", case_id(F.array().cast("array<string>"), F.col("question")))
    open_ones = open_ones.withColumn("_n", first_of).where("_n = 1")
    unanswered = dataset.seeded_sample(open_ones, "case_id", no_answer, seed).select(
        F.lit(3).alias("schema_version"), "case_id", "question", F.lit("").alias("ground_truth"), F.lit(False).alias("answerable"), F.array().cast("array<string>").alias("gold_chunk_ids"), F.lit("").alias("industry"),
        "category", F.lit("no_answer").alias("reasoning_scope"), F.array().cast("array<string>").alias("content_types"), F.struct(F.lit("needs_review").alias("status")).alias("evidence_validation"), F.lit("pending").alias("review_status"),
    )
    return answered.unionByName(unanswered, allowMissingColumns=True), dataset.rejections(checked)


def generate(spark: SparkSession, store: str, output: str, drafts: str | None = None, size: int = 150, ratio: float = 0.25, no_answer: int = 20, smoke: int = 30, regression: int = 120, seed: str = "42") -> dict:
    """Without drafts the units are written for a writer of questions; with them (JSON lines) the checked bundle."""
    folder = f"{output}/units"
    if drafts is None:
        units(spark, store, size, ratio, seed).write.mode("errorifexists").json(folder)
        made = spark.read.json(folder)
        return {"units": made.count(), "multi_chunk": made.where("scope = 'multi_chunk'").count()}
    made = spark.read.schema("unit string, scope string, source_file string, industry string, chunks array<struct<chunk_id:string,page:int,content:string,`table`:boolean>>").json(folder)
    kept, against = records(made, spark.read.schema(DRAFTS).json(drafts), no_answer, seed)
    kept = written(kept, "records")
    counts = {"answerable": kept.where("answerable").count(), "no_answer": kept.where("not answerable").count(), "rejected": {r.reason: r.n for r in against.orderBy("reason").collect()}}
    if not counts["answerable"]:
        raise ValueError("no draft with an answer holds; nothing is written")
    write_bundle(kept, f"{output}/bundle", BUCKETS, smoke, regression)
    discard([kept])
    return counts


def shared_words(queries: pd.Series, contents: pd.Series) -> pd.Series:
    """A stand-in for a reranker: the share of a query's words that a text holds."""
    words = lambda s: set(str(s).lower().split())
    return pd.Series([len(words(q) & words(c)) / max(1, len(words(q))) for q, c in zip(queries, contents)])


def run(
    spark: SparkSession, path: str, store: str, output: str, size: int = 150, top_n: int = 3, mode: str = "hybrid", seed: str = "42", verdicts: str | None = None,
    score: Callable[[pd.Series, pd.Series], pd.Series] = shared_words, embed: Callable = retrieval.hash_embedding, threshold: float = 0.0,
) -> dict:
    """A seeded sample of a set's cases searched in a store, and measured; with verdicts (JSON lines) its answers too. Details and summary lie under `output`."""
    cases = written(dataset.seeded_sample(readers.eval_records(spark, path).dropDuplicates(["case_id"]), "case_id", size, seed), "cases")
    chunks = build.chunk_store(spark, f"{store}/chunks").read()
    k = max(1, min(top_n, 10))
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), embed(F.col("content")).alias("embedding"))

    def lexical(asked: DataFrame) -> DataFrame:
        return retrieval.bm25_topk(asked, chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), 2 * searching.CANDIDATES).withColumnRenamed("doc_id", "chunk_id")

    def nearest(asked: DataFrame) -> DataFrame:
        return retrieval.vector_topk(asked.select("query_id", embed(F.col("query")).alias("embedding")), vectors, 2 * searching.CANDIDATES).withColumnRenamed("vec_id", "chunk_id")

    asked = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("query"), F.lit(k).alias("top_k"), F.lit(mode).alias("mode"))
    known = chunks.select("chunk_id", "content", "source_file", F.create_map(F.lit("industry"), "industry").alias("meta"))
    found = searching.search(asked, known, {"bm25": lexical, "vector": nearest}, score, searching.CANDIDATES, threshold=threshold)
    retrieved = found.results.select(F.col("query_id").alias("case_id"), "rank", "chunk_id", "source_file")
    places = retrieved.join(chunks.select("chunk_id", F.col("page").alias("source_page")), "chunk_id", "left")
    labels = cases.select("case_id", F.explode("gold_sources").alias("s")).select("case_id", "s.source_file", F.explode_outer("s.pages").alias("page"))
    more = evaluate.source_page_recall(places, labels).select("case_id", "source_page_recall")
    gold = cases.select("case_id", F.explode("gold_chunk_ids").alias("chunk_id")).distinct()
    ok = found.trace.select(F.col("query_id").alias("case_id"), F.lit(True).alias("retrieve_ok"))
    judged = spark.read.schema(VERDICTS).json(verdicts).join(cases.select("case_id", "answerable"), "case_id") if verdicts else None
    summary = evaluate.run(cases.select("case_id", "answerable"), retrieved, gold, judged, output, k, ok, more).first().asDict(recursive=True)
    counts = {"cases": cases.count(), **summary}
    found.close()
    discard([cases])
    return counts


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tamarack", description="Corpora, evaluation sets and evaluations on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="take in what changed in a folder")
    one.add_argument("folder")
    one.add_argument("--store", required=True)
    one = commands.add_parser("audit", help="check the labels of evaluation records")
    one.add_argument("--dataset", required=True)
    one.add_argument("--strict", action="store_true", help="exit with 1 where there are issues")
    one = commands.add_parser("generate", help="write units to ask about, then the bundle of their drafts")
    for name in ("--store", "--output"):
        one.add_argument(name, required=True)
    one.add_argument("--drafts")
    for name, default in (("--max_chunks", 150), ("--no_answer_count", 20), ("--smoke_size", 30), ("--regression_size", 120)):
        one.add_argument(name, type=int, default=default)
    one.add_argument("--multi_chunk_ratio", type=float, default=0.25)
    one.add_argument("--seed", default="42")
    one = commands.add_parser("evaluate", help="search for a set's questions and measure")
    for name in ("--dataset", "--store", "--output"):
        one.add_argument(name, required=True)
    one.add_argument("--verdicts")
    one.add_argument("--n", type=int, default=150)
    one.add_argument("--top_n", type=int, default=3)
    one.add_argument("--retrieval_mode", choices=("hybrid", "bm25", "vector"), default="hybrid")
    one.add_argument("--seed", default="42")
    given = parser.parse_args(arguments)
    spark = spark or create_session()
    if given.command == "ingest":
        report = ingest(spark, given.folder, given.store)
    elif given.command == "audit":
        report = audit(spark, given.dataset)
    elif given.command == "generate":
        report = generate(spark, given.store, given.output, given.drafts, given.max_chunks, given.multi_chunk_ratio, given.no_answer_count, given.smoke_size, given.regression_size, given.seed)
    else:
        report = run(spark, given.dataset, given.store, given.output, given.n, given.top_n, given.retrieval_mode, given.seed, given.verdicts)
    print(json.dumps(report, ensure_ascii=False, indent=2))
    return 1 if given.command == "audit" and given.strict and report["issues"] else 0


if __name__ == "__main__":
    sys.exit(main())
