"""One ingestion run: discover, compare with the manifest, parse, upsert, report; and parts that parsers share."""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import strip
from tamarack.operators.ingest import SUFFIXES, changed_files, page_limit, route, split_pieces
from tamarack.session import discard, written
from tamarack.sources.readers import discover
from tamarack.sources.writers import ChunkStore, Manifest

#: (path, bytes) to chunks: dictionaries with content and, if known, page.
Parser = Callable[[str, bytes], list[dict]]
#: Bytes a page, characters a page, share of image area, of table-like pages and of pages in columns from which a file goes to the remote parser.
ROUTE_LIMITS = (500_000.0, 80.0, 0.5, 0.3, 0.3)
STORE = "chunk_id string, content string, source_file string, industry string, page int, path string, seq bigint"


def parse_basic(path: str, content: bytes) -> list[dict]:
    """Plain text in pieces."""
    return [{"content": piece} for piece in split_pieces(content.decode("utf-8", "replace"), 500, 50)]


def parse_table(path: str, content: bytes) -> list[dict]:
    """A CSV file, one chunk a row that has anything in it."""
    rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace")))
    texts = ("；".join(f"{k}：{str(v).strip()}" for k, v in row.items() if k and v and str(v).strip()) for row in rows)
    return [{"content": text} for text in texts if text]


#: Parsers that need no library; others are given by the caller.
PARSERS: dict[str, Parser] = {"basic": parse_basic, "table": parse_table}


def parse_files(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Changed files with content -> path, hash, source_file, industry, seq, content, page, error, seconds; a file without chunks has one row of seq -1.

    A parser that is missing or fails costs its file only. A batch of files is in memory at a time, at most what Arrow's batch limits let through.
    """
    kinds = "path string, hash string, source_file string, industry string, seq bigint, content string, page int, error string, seconds double"
    names = [k.split()[0] for k in kinds.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                began, error, found = time.perf_counter(), None, []
                try:
                    found = parsers[row.parser](row.path, bytes(row.content))
                except KeyError:
                    error = f"no parser for {row.parser}"
                except Exception as problem:  # whatever a parser raises is that file's failure
                    error = f"{type(problem).__name__}: {problem}"
                took = time.perf_counter() - began
                facts = (row.path, row.hash, row.source_file, row.industry)
                rows = [(*facts, n, c["content"], c.get("page"), None, took) for n, c in enumerate(found)] or [(*facts, -1, None, None, error, took)]
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int32"})

    return files.select("path", "hash", "source_file", "industry", "parser", "content").mapInPandas(parse, kinds)


def ingest(
    spark: SparkSession, root: str, store: ChunkStore, manifest: Manifest, parsers: dict[str, Parser] | None = None, pages: DataFrame | None = None, most_pages: int = 200,
    fail_fast: bool = False, profile: Profiler | None = None, limits: tuple[float, float, float, float, float] = ROUTE_LIMITS,
) -> dict:
    """One run over a folder: status, counts and skipped files, as a dictionary.

    Files whose (path, hash) the manifest has are left alone; `pages` (path,
    pages) lets files over the limit be skipped. Changed files replace their old
    chunks, and a file that now gives none, or that is gone (or empty) while the
    folder is there, loses them. The store is written before the manifest, so a run that dies is repeated, not lost.
    With `profile`, each PDF is routed by its sampled pages to the parser pdf_local or pdf_remote.
    A store placed by path (:func:`chunk_store`) rewrites the changed files' buckets alone.
    """
    counts = dict.fromkeys(("files_discovered", "files_selected", "files_processed", "files_skipped", "files_removed", "chunks_written"), 0)
    try:
        files = written(discover(spark, root), "files")
    except AnalysisException:
        return {"status": "missing_data_dir", **counts, "skipped_files": []}
    scratch = [files]
    try:
        known = files.join(pages.select("path", "pages"), "path", "left") if pages is not None else files.withColumn("pages", F.lit(None).cast("int"))
        fitting, over = page_limit(known, most_pages)
        skipped = [r.asDict() for r in over.select("source_file", "pages", "reason").orderBy("source_file").limit(1_000).collect()]
        done = manifest.read()
        changed = written(changed_files(fitting, done), "changed")
        gone = written(done.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).join(files, "path", "left_anti").select("path"), "gone")
        scratch += [changed, gone]
        counts |= {"files_discovered": files.count(), "files_selected": changed.count(), "files_skipped": over.count() if skipped else 0, "files_removed": gone.count()}
        opened = with_content(spark, changed, root, counts["files_selected"])
        if profile is not None:
            routes = route(profiled(opened.where("parser = 'pdf'"), profile), *limits).select("path", F.concat(F.lit("pdf_"), "parser").alias("routed"))
            routes = written(routes, "routes")
            scratch.append(routes)
            opened = opened.join(routes, "path", "left").withColumn("parser", F.coalesce("routed", "parser")).drop("routed")
        rows = written(parse_files(opened, PARSERS | (parsers or {})), "parsed")
        scratch.append(rows)
        failed = rows.where("error is not null").select("path", "error").distinct()
        if fail_fast and (first := failed.orderBy("path").first()):
            raise RuntimeError(f"{first.path}: {first.error}")
        chunks = rows.where("seq >= 0").select(
            F.concat("source_file", F.lit("::"), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("chunk_id"), "content", "source_file", "industry", "page", "path", "seq"
        )
        counts |= {"files_processed": counts["files_selected"], "chunks_written": chunks.count()}
        finished = rows.where("error is null").select("path", "hash").distinct()
        if finished.limit(1).count() or counts["files_removed"]:
            store.upsert(chunks, "chunk_id", drop=("path", finished.select("path").unionByName(gone)))
            manifest.replace(finished, gone)
    finally:
        discard(scratch)
    # The states of a run.
    if not counts["files_discovered"]:
        status = "no_supported_files"
    elif not counts["files_selected"]:
        status = "no_eligible_files" if counts["files_skipped"] == counts["files_discovered"] else "up_to_date"
    else:
        status = "completed" if counts["chunks_written"] else "no_content"
    return {"status": status, **counts, "skipped_files": skipped}


def chunk_store(spark: SparkSession, path: str) -> ChunkStore:
    """A store for :func:`ingest`, placed by path."""
    return ChunkStore(spark, path, STORE, place="path")


def with_content(spark: SparkSession, changed: DataFrame, root: str, count: int, names: int = 10_000) -> DataFrame:
    """Changed files with their bytes. Up to `names` files are opened by name and no other is; beyond it the folder is read and joined."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not count:
        return changed.withColumn("content", F.lit(None).cast("binary"))
    read = content.load([r.path for r in changed.select("path").collect()]) if count <= names else content.load(root)
    return changed.join(read.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"), "path")


def run_metrics(runs: DataFrame) -> DataFrame:
    """(run, seconds, files, chunks, parse_seconds) with rates: chunks and files a second, parallelism of parsing."""
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 2)
    seconds = F.col("seconds")
    return runs.withColumns({"chunks_per_second": rate(F.col("chunks"), seconds), "files_per_second": rate(F.col("files"), seconds), "parallelism": rate(F.col("parse_seconds"), seconds)})


def remote_pages(results: DataFrame) -> DataFrame:
    """(source_file, page_offset, body) of remote parses, body a JSON object of page number to text -> source_file, page, content, has_table, chunk_id.

    Only digit keys are pages; they are sorted as numbers and moved by the
    segment's offset, and the segments of a file come together. Blank pages are left out; of one page's two texts the first by offset stays.
    """
    pages = results.select("source_file", "page_offset", F.explode(F.from_json("body", "map<string,string>")).alias("k", "content")).where(F.col("k").rlike("^[0-9]+$"))
    numbered = pages.select("source_file", (F.col("k").cast("int") + F.col("page_offset")).alias("page"), strip(F.col("content")).alias("content"), "page_offset").where("content <> ''")
    first = numbered.groupBy("source_file", "page").agg(F.min_by("content", "page_offset").alias("content"))
    number = F.lpad(F.col("page").cast("string"), 6, "0")
    return first.select("source_file", "page", "content", F.col("content").rlike(r"(?m)^\s*\|.+\|\s*$").alias("has_table"), F.concat("source_file", F.lit("::remote_"), number).alias("chunk_id"))


#: (source_file, start page, end page) to the JSON of that segment's pages, numbered from 1.
Fetch = Callable[[str, int, int], str]


def remote_parse(segments: DataFrame, fetch: Fetch, lanes: int, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """(source_file, start, end) -> source_file, page_offset, body, error, tries: each segment fetched apart, again after a failure.

    `lanes` partitions are as many requests at a time; a file's segments are
    spread over them. The pause doubles with each try. A segment that fails
    `attempts` times is a row with its last error and no body, and costs no other; a lost executor's segments are fetched anew.
    """
    kinds = "source_file string, page_offset int, body string, error string, tries int"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                body, error = None, None
                for tries in range(1, attempts + 1):
                    try:
                        body, error = fetch(row.source_file, int(row.start), int(row.end)), None
                        break
                    except Exception as problem:  # whatever a service raises is this segment's failure
                        error = f"{type(problem).__name__}: {problem}"
                        if tries < attempts:
                            time.sleep(wait * 2 ** (tries - 1))
                yield pd.DataFrame([(row.source_file, int(row.start) - 1, body, error, tries)], columns=names)

    dealt = segments.select("source_file", "start", "end").repartition(lanes, F.xxhash64("source_file", "start"))
    return dealt.mapInPandas(run, kinds)


#: (path, bytes) to a file's pages and, for sampled pages, their facts: {"pages": n, "sample": [{"n_chars", "image_area", "table_like", "two_columns"}]}.
Profiler = Callable[[str, bytes], dict]


def profiled(files: DataFrame, profile: Profiler) -> DataFrame:
    """(path, content, ...) -> path, pages, bytes_per_page and the means over sampled pages that :func:`route` takes.

    The function is given, since it needs a library for the file's format; it samples evenly by
    :func:`tamarack.operators.ingest.sample_pages`' rule or by its own. A file that it can't read has no pages and no facts.
    """
    facts = ["text_chars_per_page", "image_area_ratio", "table_like_pages_ratio", "multi_column_pages_ratio"]
    kinds = "path string, pages int, bytes_per_page double, sampled_pages bigint, " + ", ".join(f"{c} double" for c in facts)
    keys = ["n_chars", "image_area", "table_like", "two_columns"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    found = profile(row.path, bytes(row.content))
                    pages, sample = int(found["pages"]), found["sample"]
                    means = [round(sum(float(s[k]) for s in sample) / len(sample), 6) for k in keys] if sample else [None] * len(keys)
                    out.append((row.path, pages, len(row.content) / max(1, pages), len(sample), *means))
                except Exception:  # an unreadable file is routed without facts
                    out.append((row.path, None, None, 0, *[None] * len(keys)))
            yield pd.DataFrame(out, columns=["path", "pages", "bytes_per_page", "sampled_pages", *facts]).astype({"pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, kinds)


def parsed_document(chunk: Column) -> Column:
    """A parse result (content, metadata map, headings, route_reasons) as content and flat metadata: headings joined by >, reasons by ；."""
    extra = F.map_filter(
        F.map_from_arrays(F.array(F.lit("headings"), F.lit("route_reasons")), F.array(F.array_join(chunk["headings"], " > "), F.array_join(chunk["route_reasons"], "；"))),
        lambda k, v: F.length(v) > 0,
    )
    kept = F.map_filter(chunk["metadata"], lambda k, v: v.isNotNull() & ~k.isin("headings", "route_reasons"))
    return F.struct(strip(chunk["content"]).alias("content"), F.map_concat(kept, extra).alias("metadata"))


def profile_means(pages: DataFrame) -> DataFrame:
    """(source_file, page, n_chars, image_area, table_like, two_columns) of sampled pages -> a profile for routing."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return pages.groupBy("source_file").agg(
        F.count("*").cast("long").alias("sampled_pages"), share("n_chars").alias("text_chars_per_page"), share("image_area").alias("image_area_ratio"),
        share("table_like").alias("table_like_pages_ratio"), share("two_columns").alias("multi_column_pages_ratio"),
    )


def inside(path: Column, root: str) -> Column:
    """Whether a path stays below the root once its . and .. steps are taken; null paths don't."""
    steps = F.filter(F.split(F.replace(F.coalesce(path, F.lit("..")), F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    # The depth after each step; below the root it is never negative.
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda acc, s: F.struct(
            (acc["depth"] + F.when(s == "..", -1).otherwise(1)).alias("depth"), F.least(acc["least"], acc["depth"] + F.when(s == "..", -1).otherwise(1)).alias("least")
        ),
        lambda acc: acc["least"],
    )
    base = root.rstrip("/") + "/"
    relative = F.when(F.startswith(path, F.lit("/")), F.startswith(path, F.lit(base)) & ~F.contains(path, F.lit("/../"))).otherwise(walk >= 0)
    return F.coalesce(relative, F.lit(False))


def supported_suffixes() -> list[str]:
    return sorted(s for group in SUFFIXES.values() for s in group)
