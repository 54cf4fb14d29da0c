"""Tool envelopes and the evidence in them: decoding, bounding, summaries, final selection."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tamarack.functions.text import strip, trim_within

ENVELOPE = (
    "ok boolean, tool string, query string, error struct<code:string,message:string>, "
    "data struct<has_relevant_content:boolean,results:array<struct<content:string,source:string,source_file:string,page:int,source_page:int,chunk_id:string>>>"
)


def decode(envelope: Column) -> Column:
    """A JSON envelope as ok, tool, query, error_code, relevant and results; either spelling of source and page, pages under 1 null.

    Text that is no JSON object decodes to a failed call of code INVALID.
    """
    raw = F.from_json(envelope, ENVELOPE, {"mode": "PERMISSIVE"})
    page = lambda r: F.coalesce(r["page"], r["source_page"])
    results = F.transform(
        F.coalesce(raw["data"]["results"], F.array().cast("array<struct<content:string,source:string,source_file:string,page:int,source_page:int,chunk_id:string>>")),
        lambda r: F.struct(
            r["content"].alias("content"), F.coalesce(F.nullif(r["source"], F.lit("")), r["source_file"]).alias("source"), F.when(page(r) >= 1, page(r)).alias("page"), r["chunk_id"].alias("chunk_id")
        ),
    )
    valid = raw["ok"].isNotNull()
    return F.struct(
        F.coalesce(raw["ok"], F.lit(False)).alias("ok"),
        raw["tool"].alias("tool"),
        raw["query"].alias("query"),
        F.when(~valid, "INVALID").otherwise(raw["error"]["code"]).alias("error_code"),
        F.coalesce(raw["data"]["has_relevant_content"], F.size(results) > 0).alias("relevant"),
        results.alias("results"),
    )


def fair_share(items: DataFrame, budget: int, key: str = "call_id", order: str = "position", text: str = "content") -> DataFrame:
    """(key, order, text) with allowed: characters each text may keep so that a key's texts fit the budget.

    Short texts keep all of theirs and the others get equal shares of what is
    left: the level is the first, by length, that the remaining texts can't all reach.
    """
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = items.withColumn("_size", size)
    by_size = Window.partitionBy(key).orderBy("_size", order)
    shorter = F.coalesce(F.sum("_size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.count("*").over(Window.partitionBy(key)) - F.row_number().over(by_size) + 1
    level = F.greatest(F.lit(0), F.floor((budget - shorter) / rest))
    rows = rows.withColumn("_level", level)
    cut = F.max(F.when(F.col("_level") < F.col("_size"), F.col("_level"))).over(Window.partitionBy(key))
    return rows.withColumn("allowed", F.least("_size", F.coalesce(cut, F.col("_size"))).cast("int")).drop("_size", "_level")


def within_length(items: DataFrame, budget: int, key: str, order: str, columns: list[str]) -> DataFrame:
    """The first rows of each key while their JSON, one after the other, stays within the budget."""
    running = Window.partitionBy(key).orderBy(order)
    length = F.length(F.to_json(F.struct(*columns)))
    return items.withColumn("_sum", F.sum(length).over(running)).where(F.col("_sum") <= budget).drop("_sum")


def web_results(results: Column, most: int = 5, title: int = 200, content: int = 800) -> Column:
    """The first results, titles and contents cut with the mark inside the limit."""
    first = F.slice(F.coalesce(results, F.array().cast("array<struct<title:string,url:string,content:string>>")), F.lit(1), F.lit(most))
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    return F.transform(first, lambda r: F.struct(trim_within(clean(r["title"]), title).alias("title"), r["url"].alias("url"), trim_within(clean(r["content"]), content).alias("content")))


def admit_calls(calls: DataFrame, disabled: list[str], retrieval: list[str], remaining: int) -> DataFrame:
    """(batch_id, position, tool) with state: disabled tools are refused, blank names pass, retrieval calls beyond `remaining` have no slot."""
    name = F.coalesce(strip(F.col("tool")), F.lit(""))
    rows = calls.withColumn("_off", (name != "") & name.isin(disabled))
    wants = ~F.col("_off") & name.isin(retrieval)
    used = F.sum(wants.cast("int")).over(Window.partitionBy("batch_id").orderBy("position"))
    return rows.withColumn("state", F.when(F.col("_off"), "disabled").when(wants & (used > remaining), "no_slot").otherwise("admitted")).drop("_off")


def call_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, tool, ok, has_content) -> runs, errors, retrieved (successful with content) and the last successful tool."""
    good = F.col("ok").eqNullSafe(F.lit(True))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(~good).alias("errors"),
        F.count_if(good & F.col("has_content").eqNullSafe(F.lit(True))).alias("retrieved"),
        F.max_by(F.when(good, F.col("tool")), F.when(good, F.col("position"))).alias("last_ok"),
    )


def source_summary(items: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """Distinct (source, page) of each key in order of appearance, the first `most`, and how many there are."""
    firsts = items.where("source <> ''").groupBy(*keys, "source", "page").agg(F.min("position").alias("at"))
    order = Window.partitionBy(*keys).orderBy("at", "source", F.col("page").asc_nulls_first())
    rows = firsts.withColumn("rank", F.row_number().over(order)).withColumn("n_sources", F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.col("rank") <= most).drop("at")


def source_pages(items: DataFrame, keys: list[str]) -> DataFrame:
    """Sources with their distinct pages, ascending."""
    return items.groupBy(*keys, "source").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def final_evidence(ledger: DataFrame, generic: DataFrame, web: DataFrame, most: int = 32) -> DataFrame:
    """Evidence for a final answer: thread_id, kind, position, chunk_id, source, page, url.

    The ledger's rows come first, then generic rows whose (chunk, source, page) it
    lacks, then web rows of new URLs; `most` rows a thread.
    """
    place = ["chunk_id", "source", "page"]
    known = ledger.select("thread_id", *place).distinct().alias("k")
    met = F.col("g.thread_id") == F.col("k.thread_id")
    for name in place:
        met = met & F.col(f"g.{name}").eqNullSafe(F.col(f"k.{name}"))
    fresh = generic.alias("g").join(known, met, "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("thread_id", *place).orderBy("position"))).where("_n = 1").drop("_n")
    pages = web.where("url <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("thread_id", "url").orderBy("position"))).where("_n = 1")
    null = lambda kind: F.lit(None).cast(kind)
    parts = [
        (0, "ledger", ledger, [*map(F.col, place), null("string").alias("url")]),
        (1, "generic", fresh, [*map(F.col, place), null("string").alias("url")]),
        (2, "web", pages, [null("string").alias("chunk_id"), null("string").alias("source"), null("int").alias("page"), F.col("url")]),
    ]
    rows = None
    for number, kind, frame, columns in parts:
        part = frame.select("thread_id", F.lit(number).alias("_kind"), F.lit(kind).alias("kind"), "position", *columns)
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("thread_id").orderBy("_kind", "position", "chunk_id", "source", "page", "url")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_kind")


def format_metric(rows: DataFrame) -> DataFrame:
    """financial_metrics rows as lines: company metric (year): value unit, a tag on estimates, the source and page after it."""
    tag = F.when(F.col("is_estimate") == 1, F.lit(" [estimate]")).otherwise("")
    place = F.concat(F.lit(" ("), F.col("source_file"), F.coalesce(F.concat(F.lit(" p."), F.col("source_page").cast("string")), F.lit("")), F.lit(")"))
    value = F.coalesce(F.col("value").cast("string"), F.lit("-"))
    return rows.withColumn("line", F.concat("company", F.lit(" "), "metric", F.lit(" ("), "year", F.lit("): "), value, F.lit(" "), F.coalesce("unit", F.lit("")), tag, F.coalesce(place, F.lit(""))))


def _references(value, out: list[dict]) -> list[dict]:
    """Walk lists and objects from the top; an object with a source, a page or a chunk id is a reference."""
    if isinstance(value, list):
        for item in value:
            _references(item, out)
    elif isinstance(value, dict):
        source, chunk = value.get("source_file") or value.get("source"), value.get("chunk_id")
        page = value.get("source_page", value.get("page"))
        if source or page is not None or chunk:
            text = value.get("content") or value.get("excerpt")
            plain = lambda v: None if not v and v != 0 else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
            out.append({"source": plain(source or None), "page": plain(page), "chunk_id": plain(chunk or None), "content": text if isinstance(text, str) else None})
        for item in value.values():
            _references(item, out)
    return out


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("source", "page", "chunk_id", "content")])))
def _all_references(payloads: pd.Series) -> pd.Series:
    def read(payload: str | None) -> list[dict]:
        try:
            return _references(json.loads(payload or "null"), [])
        except (ValueError, RecursionError):
            return []

    return payloads.map(read)


def references(messages: DataFrame, key: str = "message_id", payload: str = "content") -> DataFrame:
    """Every reference in a tool message's JSON, at any depth and in the order of the text: key, position from 1, source, page, chunk_id, content, reference.

    Objects keep their members' order, which variant values don't, so the walk is Python by Arrow
    batches. No JSON, or deeper nesting than Python can read, gives none. The reference's words are fixed values.
    """
    found = messages.select(key, F.posexplode(_all_references(F.col(payload))).alias("position", "r")).select(key, (F.col("position") + 1).alias("position"), "r.*")
    part = lambda word, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(word), F.col(c)))
    return found.withColumn("reference", F.concat_ws("；", F.concat(F.lit("消息 "), F.col(key).cast("string")), part("来源 ", "source"), part("页码 ", "page"), part("chunk_id ", "chunk_id")))
