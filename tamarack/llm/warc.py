"""Content-addressed WARC archive.

Two tables make up an archive: `payloads` holds each distinct payload once under
its SHA-256, `records` holds the exact header bytes of every record with the
digest it points at. A join on the digest gives back whole records. Payloads
are checked against their digest on every read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a hex digest whose length is a multiple of five."""
    quintets = F.transform(
        F.sequence(F.lit(1), F.length(hex_digest), F.lit(5)), lambda i: F.lpad(F.conv(F.substring(hex_digest, i, F.lit(5)), 16, 32), 4, "0")
    )
    return F.translate(F.array_join(quintets, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, least_revisit: int = 0, date: str = EPOCH) -> DataFrame:
    """(page_id, url, html) -> page_id, digest (SHA-256), header: the exact header block of each row's record.

    Among equal payloads of at least `least_revisit` bytes the least page_id is
    the response and the others revisit it; repeats of that same page_id are
    responses too. Null ids come after all others, a null html is an empty
    payload, and a null url has no target line. Line ends in a url are escaped.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = pages.select(
        "page_id",
        F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.sha2(payload, 256).alias("digest"),
        base32(F.sha1(payload)).alias("sha1"),
        F.length(payload).cast("long").alias("size"),
    )
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("size") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    return facts.join(firsts, "digest").select("page_id", "digest", header.cast("binary").alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """Each distinct payload once: digest, payload. Copies are dropped before the shuffle."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).dropDuplicates(["digest"])


def write_archive(pages: DataFrame, path: str, least_revisit: int = 0) -> None:
    payloads(pages).write.parquet(f"{path}/payloads")
    records(pages, least_revisit).write.parquet(f"{path}/records")


def _field(header: Column, name: str, value: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record joined to its payload.

    Columns: header and payload (bytes), record (the whole WARC record), page_id,
    record_type, refers_to, target_uri, payload_bytes, payload_digest and
    header_digest. A payload that fails its digest is an error. What a
    caller doesn't select doesn't travel through the join.
    """
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload fails its digest "), F.col("digest")))
    )
    stored = spark.read.parquet(f"{path}/payloads").select("digest", checked.alias("payload"))
    stored = stored.select("*", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    text = F.col("header").cast("string")
    kept = spark.read.parquet(f"{path}/records").select(
        "digest",
        "header",
        F.expr("try_cast(regexp_extract(cast(header as string), '\\r\\nWARC-Record-ID: <urn:x-page:([^>]*)>\\r\\n', 1) as bigint)").alias("page_id"),
        _field(text, "WARC-Type", "([a-z]+)").alias("record_type"),
        F.expr("try_cast(regexp_extract(cast(header as string), '\\r\\nWARC-Refers-To: <urn:x-page:([^>]*)>\\r\\n', 1) as bigint)").alias("refers_to"),
        _field(text, "WARC-Target-URI", "([^\r]*)").alias("target_uri"),
        _field(text, "WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("header_digest"),
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return kept.join(stored, "digest").withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))
