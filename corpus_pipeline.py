"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

Each stage reads what the one before it kept. The stages filter or rewrite
documents; the last one says how many words of each the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontam, mixing, quality, secret_scan, simhash
from tamarack.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ACCEPT = 0.3
NEAR, ALIKE = 15, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ACCEPT or more; the model learns from labelled rows that are not held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).where(F.col("score") >= ACCEPT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id in each group of near copies; rows that repeat an id and text count once.

    Fingerprints of five-word shingles within NEAR bits are compared, and texts linked that share ALIKE of their shingles or more.
    """
    # Trees prune little at this radius: large leaves and blocks repeat fewer rows.
    found = simhash.near_duplicates(docs, radius=NEAR, width=5, least=ALIKE, leaf=40_000, block=40_000)
    kept = materialize(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "kept")
    # One shuffle by doc_id serves the join and the repeats.
    rows = docs.select(*COLUMNS).where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    unnamed = docs.select(*COLUMNS).where("doc_id is null").dropDuplicates(["text"])
    return rows.select(*COLUMNS).unionByName(unnamed.join(kept.where("doc_id is null").withColumnRenamed("doc_id", "kept_id"), F.expr("doc_id <=> kept_id"), "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.without_hits(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text where it changed."""
    model = secret_scan.fit(secret_scan.samples(spark, docs, table(spark, sf_dir, "labels")))
    found = secret_scan.scan(docs, model, keep=tuple(COLUMNS))
    changed = F.size("spans") > 0
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    redacted = found.select("doc_id", text.alias("text"), "lang", "source", "n_chars", changed.alias("changed"))
    return redacted.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifiers and XXH64 fingerprints are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
