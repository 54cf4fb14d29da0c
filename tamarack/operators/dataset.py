"""Building evaluation sets: sampling, pairing, evidence checks, splits, semantic dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import compact, is_noise, strip, unsupported_numbers
from tamarack.operators.cache import greedy_keep
from tamarack.session import written

# Vague subjects of a question.
AMBIGUOUS = "该公司|该行业|本项目|上述公司|这家公司"


def shuffle_key(*columns: str, seed: str = "0") -> Column:
    """A seeded, engine-independent shuffle order."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def drop_noise(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Without boilerplate and texts under 100 characters."""
    return chunks.where(~is_noise(F.col(text)))


def stratified_sample(chunks: DataFrame, strata: list[str], source: str, key: str, size: int, seed: str = "0") -> DataFrame:
    """Round robin over strata, and over the sources inside each: `size` rows, whatever their partitions.

    A row's place in its source, its source's place in that round, and its
    stratum's place in the sample follow seeded hashes; ties fall to the key. No more than
    `size` rows of a source, or of a stratum, can be taken, so each task cuts its own to that before the shuffle.
    """
    rows = chunks.withColumn("_h", shuffle_key(key, seed=seed)).withColumn("_s", shuffle_key(source, seed=seed)).withColumn("_g", shuffle_key(*strata, seed=seed))
    rows = rows.withColumn("_round", F.row_number().over(Window.partitionBy(*strata, source).orderBy("_h", key))).where(F.col("_round") <= size)
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*strata).orderBy("_round", "_s", source))).where(F.col("_turn") <= size)
    order = ["_turn", "_g", *strata, key]
    return rows.orderBy(*order).limit(size).withColumnRenamed("_turn", "turn").drop("_h", "_s", "_g", "_round")


def balanced_subset(records: DataFrame, buckets: list[str], size: int, seed: str = "0") -> DataFrame:
    """Round robin over buckets of records (case_id): `size` rows."""
    rows = records.withColumn("_h", shuffle_key("case_id", seed=seed)).withColumn("_g", shuffle_key(*buckets, seed=seed))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*buckets).orderBy("_h", "case_id"))).where(F.col("turn") <= size)
    return rows.orderBy("turn", "_g", *buckets, "case_id").limit(size).drop("_h", "_g")


#: Neighbours that are a pair.
NEAR = "next_id is not null and abs(next_page - page) <= 1"


def adjacent_pairs(chunks: DataFrame) -> DataFrame:
    """Unordered pairs of neighbours of a source whose pages differ by one at most.

    (source_file, page, chunk_id) -> source_file, a, b with a < b. Order within a
    source is by page, nulls last, then chunk id; a null page pairs with nothing.
    """
    return _with_next(chunks).where(NEAR).select("source_file", F.least("chunk_id", "next_id").alias("a"), F.greatest("chunk_id", "next_id").alias("b")).distinct()


def _with_next(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_file").orderBy(F.col("page").asc_nulls_last(), "chunk_id")
    return chunks.select("source_file", "page", "chunk_id", F.lead("chunk_id").over(order).alias("next_id"), F.lead("page").over(order).alias("next_page"))


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """(case_id, question, answer, scope, chunks, evidence array<struct<chunk_index, quote>>) -> case_id, accepted, reasons."""
    size = F.size("chunks")
    quote = lambda e: compact(e["quote"])
    valid = lambda e: (e["chunk_index"] >= 1) & (e["chunk_index"] <= size)
    corpus = lambda e: compact(F.get("chunks", (e["chunk_index"] - 1).cast("int")))
    reason = lambda e: (
        F.when(~valid(e), "invalid_evidence_chunk_index")
        .when(F.length(quote(e)) < 6, "evidence_too_short")
        .when(~F.contains(corpus(e), quote(e)), "evidence_quote_not_found")
    )
    used = F.array_distinct(F.transform(F.filter("evidence", lambda e: valid(e) & (F.length(quote(e)) >= 6)), lambda e: e["chunk_index"]))
    missing = F.array_sort(unsupported_numbers(F.col("answer"), F.array_join("chunks", "\n")))
    question, answer = strip(F.col("question")), strip(F.col("answer"))
    reasons = F.concat(
        F.array(
            F.when(F.length(question) < 6, "question_too_short"),
            F.when(question.rlike(AMBIGUOUS), "ambiguous_question"),
            F.when(F.length(answer) < 2, "answer_too_short"),
            F.when(F.size("evidence") == 0, "missing_evidence_quotes"),
        ),
        F.transform("evidence", reason),
        F.array(
            F.when((F.col("scope") == "multi_chunk") & (F.size(used) < 2), "multi_chunk_evidence_incomplete"),
            F.when(F.size(missing) > 0, F.concat(F.lit("unsupported_answer_numbers:"), F.array_join(missing, ","))),
        ),
    )
    found = pairs.withColumn("reasons", F.array_distinct(F.filter(reasons, F.isnotnull)))
    return found.select("case_id", (F.size("reasons") == 0).alias("accepted"), "reasons")


def strata_counts(chunks: DataFrame, strata: list[str], source: str) -> DataFrame:
    return chunks.groupBy(*strata).agg(F.count("*").alias("n"), F.count_distinct(source).alias("n_sources"))


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Groups of equal texts: digest, n, first key."""
    return docs.groupBy(F.md5(F.col(text)).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def corpus_quality(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Per group: documents, characters, tables, replacement characters, short texts."""
    return docs.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(F.length(text)).alias("chars"),
        F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("�"), F.lit("")))).alias("replacements"),
        F.count_if(F.col(text).rlike(r"(?m)^\s*\|.+\|\s*$")).alias("tables"),
        F.count_if(F.length(strip(F.col(text))) < 100).alias("short"),
    )


# Characters a page of a scan, of a page that is an image, and of a text whose script is judged; shares; the flags' words.
SCAN_CHARS, IMAGE_CHARS, JUDGED_CHARS, IMAGE_SHARE, LEAST_CJK = 100, 50, 50, 0.3, 0.1
SCAN, PART_SCAN, GARBLED = "全量扫描版", "部分扫描(%s%%页为图片)", "疑似乱码(中文仅占%s%%)"


def scan_quality(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages (key, text, images) -> key, pages, total_chars, avg_chars, cjk_ratio, image_ratio, issues.

    A page of few characters with an image on it is an image page. A document
    with few characters a page is a scan; else it may be a scan in part, and garbled where
    little of it is CJK. Shares in the flags are rounded half-up; null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    image = (F.length(strip(text)) < IMAGE_CHARS) & (F.coalesce("images", F.lit(0)) > 0)
    cjk = F.length(F.regexp_replace(text, "[^\u4e00-\u9fff]", ""))
    sums = pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum(F.length(text)).alias("total_chars"), F.sum(cjk).alias("_cjk"), F.count_if(image).alias("_images"))
    share = F.coalesce(F.try_divide("_cjk", "total_chars"), F.lit(0.0))
    rows = sums.withColumns({"_share": share, "image_ratio": F.col("_images") / F.col("pages"), "_scan": F.col("total_chars") < SCAN_CHARS * F.col("pages")})
    percent = lambda value, places: F.format_string(f"%.{places}f", F.round(value * 100, places))
    flagged = lambda form, value, places: F.format_string(form, percent(F.col(value), places))
    issues = F.array(
        F.when(F.col("_scan"), SCAN), F.when(~F.col("_scan") & (F.col("image_ratio") > IMAGE_SHARE), flagged(PART_SCAN, "image_ratio", 0)),
        F.when(~F.col("_scan") & (F.col("total_chars") >= JUDGED_CHARS) & (F.col("_share") < LEAST_CJK), flagged(GARBLED, "_share", 1)),
    )
    return rows.select(key, "pages", "total_chars", F.floor(F.col("total_chars") / F.col("pages")).alias("avg_chars"), F.round("_share", 4).alias("cjk_ratio"), F.round("image_ratio", 4).alias("image_ratio"), F.filter(issues, F.isnotnull).alias("issues"))


def manifest(records: DataFrame) -> DataFrame:
    """Counts that go with a bundle."""
    yes = ~F.col("answerable").eqNullSafe(F.lit(False))
    return records.agg(
        F.count("*").alias("records"),
        F.count_if(yes).alias("answerable"),
        F.count_if(~yes).alias("no_answer"),
        F.count_if(F.col("reasoning_scope") == "multi_chunk").alias("multi_chunk"),
        F.count_if(F.array_contains("content_types", "table")).alias("table_cases"),
        F.count_if(F.col("review_status") == "pending").alias("pending_review"),
    )


def seeded_sample(rows: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """`size` rows in a seeded order; all of them if there are no more."""
    return rows.orderBy(shuffle_key(key, seed=seed), key).limit(size)


def disjoint_pairs(pairs: DataFrame, size: int | None = None, seed: str | None = None) -> DataFrame:
    """Pairs (source_file, a, b) that share no chunk with a pair taken before; the first `size` of them.

    They are gone through in a seeded order, or by source, a and b without a seed.

    The choice is the one that goes through all pairs one by one: a pair waits
    only for pairs before it that share a chunk, so many are settled in each round. A chunk
    has two neighbours at most, so its pairs meet in a small join.
    """
    drawn = [] if seed is None else [shuffle_key("source_file", "a", "b", seed=seed).alias("drawn")]
    mark = F.struct(*drawn, "source_file", "a", "b")
    rows = written(pairs.withColumn("_at", mark), "pairs")
    ends = rows.select("source_file", "_at", F.explode(F.array("a", "b")).alias("chunk"))
    links = ends.withColumnRenamed("_at", "left_id").join(ends.withColumnRenamed("_at", "right_id"), ["source_file", "chunk"]).where("left_id < right_id")
    kept = greedy_keep(rows, links.select("left_id", "right_id").distinct(), "_at").where("kept")
    taken = rows.join(kept.select("_at"), "_at", "left_semi")
    return (taken if size is None else taken.orderBy("_at").limit(size)).drop("_at")


def disjoint_neighbours(chunks: DataFrame, size: int | None = None, seed: str | None = None) -> DataFrame:
    """What `disjoint_pairs` takes of `adjacent_pairs`: source_file, a, b; chunk ids are unique in their source.

    The pairs of a source lie in a row, and each shares a chunk with the one
    before and the one behind at most. From a pair that both of these come after, which is
    taken, every second one is taken while the marks ascend; where two ascents meet, the pair
    is taken if both would take it. So windows over each source's order tell it without rounds: one
    shuffle by source, whatever the length of the chains.
    """
    source = Window.partitionBy("source_file")
    ahead, back = source.orderBy(F.col("page").asc_nulls_last(), "chunk_id"), source.orderBy(F.col("page").desc_nulls_first(), F.desc("chunk_id"))
    rows = _with_next(chunks).select("source_file", "page", "chunk_id", F.when(F.expr(NEAR), F.struct(F.least("chunk_id", "next_id").alias("a"), F.greatest("chunk_id", "next_id").alias("b"))).alias("pair"))
    rows = rows.select("*", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    drawn = [] if seed is None else [shuffle_key("source_file", "a", "b", seed=seed).alias("drawn")]
    rows = rows.withColumn("mark", F.when(F.col("pair").isNotNull(), F.struct(*drawn, "a", "b"))).drop("pair")
    rows = rows.withColumns({"n": F.row_number().over(ahead), "before": F.lag("mark").over(ahead), "behind": F.lead("mark").over(ahead)})
    starts = lambda other: F.when(F.col("mark").isNotNull() & (F.col(other).isNull() | (F.col(other) > F.col("mark"))), F.col("n"))
    rows = rows.withColumns({"from_left": starts("before"), "from_right": starts("behind")}).drop("before", "behind")
    rows = rows.withColumn("from_left", F.last("from_left", True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("from_right", F.last("from_right", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    taken = rows.where(F.col("mark").isNotNull() & ((F.col("n") - F.col("from_left")) % 2 == 0) & ((F.col("from_right") - F.col("n")) % 2 == 0))
    if size is not None:
        taken = taken.orderBy(*(["mark.drawn"] if drawn else []), "source_file", "a", "b").limit(size)
    return taken.select("source_file", "a", "b")


def evidence_units(chunks: DataFrame, pairs: DataFrame | None, ratio: float, seed: str = "0") -> DataFrame:
    """(source_file, chunk_id) with scope and unit: chunks of taken pairs go together, the others alone.

    As many pairs are taken as `ratio` of the chunks, between 0 and 0.5. Without `pairs`
    they are neighbours: chunks have a page then, and ids unique in their source.
    """
    wanted = round(chunks.count() * max(0.0, min(ratio, 0.5)))
    taken = disjoint_neighbours(chunks, wanted, seed) if pairs is None else disjoint_pairs(pairs, wanted, seed)
    unit = F.concat_ws("+", "a", "b")
    pairs_of = taken.select("source_file", unit.alias("unit"), F.explode(F.array("a", "b")).alias("chunk_id"))
    met = chunks.select("source_file", "chunk_id").join(pairs_of, ["source_file", "chunk_id"], "left")
    return met.select(
        "source_file", "chunk_id", F.when(F.col("unit").isNull(), "single_chunk").otherwise("multi_chunk").alias("scope"), F.coalesce("unit", F.col("chunk_id").cast("string")).alias("unit")
    )


def rejections(checked: DataFrame) -> DataFrame:
    """(accepted, reasons) -> reason, n; a reason's details after the colon don't count."""
    return checked.where("not accepted").select(F.explode("reasons").alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def with_verdicts(records: DataFrame, verdicts: DataFrame, fallback: Column) -> DataFrame:
    """Records with the judge's behavior for their case_id; where it has none, `fallback` of the record. judged tells which."""
    found = verdicts.where("behavior is not null").groupBy("case_id").agg(F.min("behavior").alias("_verdict"))
    met = records.join(found, "case_id", "left")
    return met.withColumn("judged", F.col("_verdict").isNotNull()).withColumn("behavior", F.coalesce("_verdict", fallback)).drop("_verdict")
