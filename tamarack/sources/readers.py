"""Sources: files, tables of chunks, evaluation records, event streams of text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarack.functions.metadata import clamp
from tamarack.functions.text import row_text, strip
from tamarack.operators.ingest import parser_of, source_identity

CHUNKS = "chunk_id string, content string, metadata_json string, document_id string, seq bigint"
EVAL_RECORDS = (
    "schema_version int, case_id string, question string, ground_truth string, answerable boolean, gold_chunk_ids array<string>, "
    "gold_sources array<struct<source_file:string,pages:array<int>>>, source_file string, page int, industry string, category string, "
    "reasoning_scope string, content_types array<string>, parsers array<string>, gold_evidence array<struct<chunk_id:string,quote:string>>, "
    "evidence_validation struct<status:string,checks:array<string>,reason:string>, review_status string, review_notes string, chunk_text string"
)
# Bands of a question's length and of words that mark it as noise.
LEAST_QUESTION = 5


def discover(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder that some parser takes: path, length, hash (md5), parser, source_file, industry."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    local = F.regexp_replace("path", "^file:/*", "/")
    named = files.select(local.alias("path"), "length", F.md5("content").alias("hash"), parser_of(F.col("path")).alias("parser"))
    return named.where("parser is not null").select("*", source_identity(F.col("path"), root).alias("s")).select("path", "length", "hash", "parser", "s.*")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text: whole text files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """CSV tables as one chunk a row: row_number within its file (the header is row 1), content, path; empty rows are left out.

    Rows are numbered within their split and moved by the counts of the splits
    before it, so a large file is many tasks' work. `lines` lets cells hold line ends; a file is then one split.
    """
    frame = spark.read.option("encoding", "UTF-8").option("multiLine", lines).csv(path, header=True)
    clean = [c.lstrip("﻿") for c in frame.columns]
    named = frame.select(*(F.col(f"`{old}`").alias(f"c{k}") for k, old in enumerate(frame.columns)), "_metadata.file_path", "_metadata.file_block_start")
    rows = named.select("file_path", "file_block_start", F.monotonically_increasing_id().alias("at"), row_text([f"c{k}" for k in range(len(clean))], clean).alias("content"))
    within = F.row_number().over(Window.partitionBy("file_path", "file_block_start").orderBy("at"))
    splits = rows.groupBy("file_path", "file_block_start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file_path", "file_block_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("within", within).join(splits, ["file_path", "file_block_start"])
    return numbered.select((F.col("before") + F.col("within") + 1).alias("row_number"), "content", F.col("file_path").alias("path")).where("content <> ''")


def sheets(spark: SparkSession, paths: str, parse: Callable[[bytes], dict[str, pd.DataFrame]]) -> DataFrame:
    """Workbooks by an injected parser of bytes to frames: path, sheet, row_number, content."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                for sheet, rows in parse(content).items():
                    for number, row in enumerate(rows.to_dict("records"), 2):
                        text = "；".join(f"{k}：{str(v).strip()}" for k, v in row.items() if pd.notna(v) and str(v).strip())
                        if text:
                            out.append((path, sheet, number, text))
            yield pd.DataFrame(out, columns=["path", "sheet", "row_number", "content"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(read, "path string, sheet string, row_number int, content string")


def parsed_files(files: DataFrame, parse: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Any file parser (path, bytes) -> rows, one file at a time, in its own task's memory."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"]) for row in parse(path, content)]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(read, schema)


def scan_chunks(chunks: DataFrame, source: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Chunks in store order; of one source if given (its source_file or its source); a page of them if limited."""
    rows = chunks.withColumn("document_id", F.coalesce(F.nullif("document_id", F.lit("")), F.col("chunk_id")))
    if source is not None:
        meta = lambda k: F.get_json_object("metadata_json", f"$.{k}") == source
        rows = rows.where(F.coalesce(meta("source_file"), F.lit(False)) | F.coalesce(meta("source"), F.lit(False)))
    rows = rows.orderBy("seq")
    return rows.offset(max(0, offset)).limit(max(1, limit)) if limit is not None else rows


def eval_records(spark: SparkSession, path: str, noise: str | None = None) -> DataFrame:
    """Evaluation records of a JSON-lines file; broken lines, short questions and those with a noise pattern dropped."""
    rows = spark.read.schema(EVAL_RECORDS).option("mode", "DROPMALFORMED").json(path)
    kept = rows.where(F.length(strip(F.col("question"))) >= LEAST_QUESTION)
    return kept.where(~F.col("question").rlike(noise)) if noise else kept


def line_audit(lines: DataFrame) -> DataFrame:
    """(value) lines of a JSON-lines file -> lines, objects, not_objects, invalid."""
    text = lines.where(F.length(strip(F.col("value"))) > 0).select(F.expr("try_parse_json(value)").alias("v"), "value")
    kind = F.when(F.col("v").isNull() & (strip(F.col("value")) != "null"), "invalid").when(strip(F.col("value")).startswith("{"), "object").otherwise("other")
    return text.select(kind.alias("k")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("k") == "object").alias("objects"),
        F.count_if(F.col("k") == "other").alias("not_objects"), F.count_if(F.col("k") == "invalid").alias("invalid"),
    )


def server_events(lines: DataFrame) -> DataFrame:
    """(stream_id, line_no, line) of server-sent events -> stream_id, event_no, event, data.

    A blank line ends an event, comment lines are skipped, data lines are joined by line ends.
    """
    order = Window.partitionBy("stream_id").orderBy("line_no")
    rows = lines.withColumn("event_no", F.sum((F.coalesce(F.lag("line").over(order), F.lit("x")) == "").cast("int")).over(order))
    rows = rows.where("line <> '' and not startswith(line, ':')")
    name, value = F.split_part("line", F.lit(":"), F.lit(1)), F.regexp_replace(F.regexp_replace("line", "^[^:]*:?", ""), "^ ", "")
    parts = rows.select("stream_id", "event_no", "line_no", name.alias("name"), value.alias("value"))
    grouped = parts.groupBy("stream_id", "event_no").agg(
        F.max_by(F.when(F.col("name") == "event", F.col("value")), F.when(F.col("name") == "event", F.col("line_no"))).alias("event"),
        F.array_sort(F.collect_list(F.when(F.col("name") == "data", F.struct("line_no", "value")))).alias("d"),
    )
    return grouped.where(F.size("d") > 0).select("stream_id", "event_no", F.coalesce("event", F.lit("message")).alias("event"), F.array_join(F.transform("d", lambda x: x["value"]), "\n").alias("data"))


def page_bounds(limit, offset):
    """A page size in 1..100 and an offset of 0 or more."""
    return clamp(limit, 1, 100, 20), F.greatest(F.lit(0), F.coalesce(offset, F.lit(0)))


class PagedChunks(DataSource):
    """A remote chunk listing read page by page, one partition a page; the last one reads on until a page is short.

    Options: fetch (module:function of (offset, limit) -> list of JSON objects), total (rows that are known of, 0 by default), page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_chunks"

    def schema(self) -> str:
        return "chunk_id string, content string, metadata_json string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.total, self.page = options["fetch"], int(options.get("total", "0")), int(options.get("page", "100"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, self.total + 1, self.page)]

    def read(self, partition):
        import importlib

        module, function = self.fetch.split(":")
        fetch, at = getattr(importlib.import_module(module), function), partition.value
        while True:
            rows = fetch(at, self.page)
            for row in rows:
                yield row.get("chunk_id"), row.get("content"), json.dumps(row.get("metadata") or {}, ensure_ascii=False)
            at += self.page
            if at <= self.total or len(rows) < self.page:
                return


def supported(path: str) -> bool:
    from tamarack.operators.ingest import SUFFIXES

    return PurePosixPath(path.replace("\\", "/")).suffix.lower().lstrip(".") in {s for group in SUFFIXES.values() for s in group}
