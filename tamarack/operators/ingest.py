"""Ingestion: change detection, splitting, upserts, batch cuts, parse quality and routing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import HELD_CHARS, strip
from tamarack.operators.running import running_sums

# File suffixes by parser.
SUFFIXES = {"pdf": ["pdf"], "basic": ["docx", "txt", "md", "markdown", "py"], "table": ["csv", "xlsx", "xls"]}
#: Separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def parser_of(path: Column) -> Column:
    """Parser name by suffix; null where no parser takes the file."""
    out = F.lit(None).cast("string")
    for name, suffixes in SUFFIXES.items():
        out = F.when(suffix(path).isin(suffixes), name).otherwise(out)
    return out


def required_parser(path: Column) -> Column:
    """Parser name by suffix; a file that none takes is an error."""
    return F.coalesce(parser_of(path), F.raise_error(F.concat(F.lit("no parser takes "), path)))


def source_identity(path: Column, root: str) -> Column:
    """Relative path, and its first folder as the industry."""
    plain, base = F.replace(path, F.lit("\\"), F.lit("/")), F.lit(root.rstrip("/") + "/")
    relative = F.when(F.startswith(plain, base), F.substring(plain, F.length(base) + 1, F.length(plain))).otherwise(plain)
    folder = F.when(F.contains(relative, F.lit("/")), F.split_part(relative, F.lit("/"), F.lit(1)))
    return F.struct(relative.alias("source_file"), folder.alias("industry"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, hash) whose hash the manifest lacks."""
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def page_limit(files: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(files within the limit, skipped files with a reason)."""
    over = F.coalesce(F.col("pages") > most, F.lit(False))
    return files.where(~over), files.where(over).withColumn("reason", F.concat(F.lit("pages>"), F.lit(str(most))))


def split_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does, neighbours sharing up to `overlap`."""
    separator = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(separator) + 1 :]
    atoms = list(text) if separator == "" else [a for a in text.split(separator) if a]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        piece = separator.join(held).strip()
        if piece:
            out.append(piece)

    def width(parts: list[str]) -> int:
        return sum(map(len, parts)) + len(separator) * max(0, len(parts) - 1)

    for atom in atoms:
        if len(atom) > size and rest:
            flush()
            held = []
            out.extend(split_pieces(atom, size, overlap, rest))
            continue
        if held and width([*held, atom]) > size:
            flush()
            while held and (width(held) > overlap or width([*held, atom]) > size):
                held.pop(0)
        held.append(atom)
    flush()
    return out


def split_text(docs: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """key, seq, chunk_id, content: each whole text in pieces; ids are key::basic_000000 and on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("k", pa.string()), ("seq", pa.int32()), ("content", pa.string())])
        for batch in batches:
            held: list[tuple[str, int, str]] = []
            room = HELD_CHARS
            for k, t in zip(batch.column(0), batch.column(1)):
                whole = t.as_py()
                held += [(k.as_py(), i, p) for i, p in enumerate(split_pieces(whole, size, overlap))] if whole else []
                room -= len(whole or "")
                if held and room <= 0:  # a few texts at a time, whatever the batch's size
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                    held, room = [], HELD_CHARS
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    cuts = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(cut, "k string, seq int, content string")
    return cuts.select("k", "seq", F.concat("k", F.lit("::basic_"), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("chunk_id"), "content")


def row_id(chunk_id: Column, document_id: Column, position: Column) -> Column:
    """chunk id, else document id, else chunk_ and the position."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.nullif(document_id, F.lit("")), F.concat(F.lit("chunk_"), position.cast("string")))


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last by `seq`."""
    if seq:
        order = Window.partitionBy(key).orderBy(F.desc(seq))
        new = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first new row of each key that the old rows lack."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(old.select(*keys), keys, "left_anti")


def batch_cut(chunks: DataFrame, size: int, file: str, order: list[str], lane: str | None = None) -> DataFrame:
    """With batch and done_batch: chunks in order in batches of `size`; a file is done with the batch of its last chunk.

    Batches are numbered within a lane (one writer's share); without one, all
    rows are one sequence, numbered in two levels, and `order` is to be unique.
    """
    if lane:
        running = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
        rows = chunks.withColumn("batch", F.floor((running - 1) / size).cast("long"))
        return rows.withColumn("done_batch", F.max("batch").over(Window.partitionBy(lane, file)))
    numbered = running_sums(chunks, [], order, {"_n": F.lit(1).cast("long")})
    rows = numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")
    done = rows.groupBy(F.col(file).alias("_file")).agg(F.max("batch").alias("done_batch"))
    return rows.join(done, F.col(file).eqNullSafe(F.col("_file"))).drop("_file")


def page_segments(pages: Column, size: int = 3) -> Column:
    """array<struct<start, end>> over pages 1..n."""
    starts = F.sequence(F.lit(1), F.greatest(pages, F.lit(1)), F.lit(size))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, pages).alias("end")))
    return F.when(pages > 0, cut).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def sample_pages(pages: Column, wanted: int) -> Column:
    """Evenly spaced page numbers from 0, first and last among them."""
    n = F.least(F.greatest(F.lit(wanted), F.lit(1)), pages)
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (pages - 1) / (n - 1)).cast("int"))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).otherwise(F.array_distinct(steps))


def route(profile: DataFrame, image_bytes: float, least_chars: float, image_area: float, table_share: float, column_share: float) -> DataFrame:
    """PDF profiles -> parser, ocr, reasons. Any reason sends the file to the remote parser, scans with forced OCR."""
    sparse, pictures = F.col("text_chars_per_page") < least_chars, F.col("image_area_ratio") >= image_area
    reasons = F.filter(
        F.array(
            F.when(F.col("bytes_per_page") >= image_bytes, "heavy_pages"),
            F.when(sparse, "little_text"),
            F.when(pictures, "large_images"),
            F.when(F.col("table_like_pages_ratio") >= table_share, "numeric_tables"),
            F.when(F.col("multi_column_pages_ratio") >= column_share, "multiple_columns"),
        ),
        F.isnotnull,
    )
    rows = profile.withColumn("reasons", reasons)
    remote = F.size("reasons") > 0
    return rows.withColumn("parser", F.when(remote, "remote").otherwise("local")).withColumn(
        "ocr", F.when(~remote, "disabled").when(sparse & pictures, "force").otherwise("auto")
    )


def parse_quality(chunks: DataFrame, files: DataFrame, coverage: float = 0.65, chars: float = 80, replaced: float = 0.005, traceable: float = 0.95) -> DataFrame:
    """chunks (source_file, page, content), files (source_file, pages) -> ratios, reasons, acceptable."""
    met = files.join(chunks, "source_file", "left")
    valid = F.when((F.col("page") >= 1) & (F.col("page") <= F.col("pages")), F.col("page"))
    text = F.coalesce("content", F.lit(""))
    sums = met.groupBy("source_file", "pages").agg(
        F.count("content").alias("n"),
        F.count_distinct(valid).alias("found"),
        F.sum(F.length(text)).alias("letters"),
        F.sum(F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).alias("bad"),
        F.count_if(F.col("content").isNotNull() & F.col("page").isNotNull()).alias("traced"),
    )
    most = F.greatest("pages", F.lit(1))
    rows = sums.select(
        "source_file", "pages", "n",
        F.round(F.col("found") / most, 6).alias("page_coverage"),
        F.round(F.col("letters") / most, 6).alias("chars_per_page"),
        F.round(F.col("bad") / F.greatest("letters", F.lit(1)), 6).alias("replacement_ratio"),
        F.round(F.col("traced") / F.greatest("n", F.lit(1)), 6).alias("traceable_ratio"),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("n") == 0, "no_content"),
            F.when((F.col("pages") >= 3) & (F.col("page_coverage") < coverage), "low_coverage"),
            F.when(F.col("chars_per_page") < chars, "little_text"),
            F.when(F.col("replacement_ratio") > replaced, "garbled"),
            F.when((F.col("n") > 0) & (F.col("traceable_ratio") < traceable), "untraceable"),
        ),
        F.isnotnull,
    )
    return rows.withColumn("reasons", reasons).withColumn("acceptable", F.size("reasons") == 0)


def reading_order(blocks: DataFrame, gap: float = 0.12) -> DataFrame:
    """(doc, page, block, x0, y0, x1, y1, width) -> with column and position.

    A page has two columns where blocks lie on both sides of its middle and the
    gap between them is more than `gap` of its width; left then right, each by y.
    """
    page = Window.partitionBy("doc", "page")
    left = F.col("x1") <= F.col("width") / 2 * 1.1
    inner = F.max(F.when(left, F.col("x1"))).over(page)
    outer = F.min(F.when(~left, F.col("x0"))).over(page)
    rows = blocks.withColumn("_two", F.coalesce((outer - inner) > gap * F.col("width"), F.lit(False)))
    rows = rows.withColumn("column", F.when(F.col("_two") & ~left, 1).otherwise(0))
    return rows.withColumn("position", F.row_number().over(page.orderBy("column", "y0", "x0", "block"))).drop("_two")


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.4) -> DataFrame:
    """Blocks whose overlap with every table of their page is under `share` of their own area."""
    t = tables.select("doc", "page", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    width = F.greatest(F.lit(0.0), F.least("x1", "t_x1") - F.greatest("x0", "t_x0"))
    height = F.greatest(F.lit(0.0), F.least("y1", "t_y1") - F.greatest("y0", "t_y0"))
    area = F.greatest(F.lit(1e-9), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    inside = blocks.join(t, ["doc", "page"]).where(width * height / area >= share).select("doc", "page", "block").distinct()
    return blocks.join(inside, ["doc", "page", "block"], "left_anti")


def body_blocks(blocks: DataFrame, band: float = 0.07, least: int = 3) -> DataFrame:
    """Without page headers and footers (the outer band of the height) and very short texts."""
    return blocks.where((F.col("y0") >= band * F.col("height")) & (F.col("y1") <= (1 - band) * F.col("height")) & (F.length(strip(F.col("text"))) >= least))


def report(outcomes: DataFrame) -> DataFrame:
    """(path, status, chunks) -> one row of counts."""
    return outcomes.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "added", F.col("chunks"))), F.lit(0)).alias("chunks"),
    )


def stage_totals(events: DataFrame) -> DataFrame:
    """(stage, seconds, ok) -> totals and failures."""
    return events.groupBy("stage").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.count_if(~F.col("ok")).alias("failures"), F.count("*").alias("n"))


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, hash string")
