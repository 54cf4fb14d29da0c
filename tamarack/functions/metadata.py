"""Metadata maps: a fixed core with aliases, safe casts, and an open tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import strip

#: Core keys and the older spelling that stands in only where the key is absent, not where it is null.
ALIASES = {"source_page": "page", "retrieval_score": "score", "source_path": "source"}
CORE = ["source_file", "source_path", "source_page", "source_pages", "chunk_id", "doc_type", "industry", "retrieval_score", "page", "score", "source"]


def safe_text(value: Column) -> Column:
    return F.nullif(strip(value.cast("string")), F.lit(""))


def safe_int(value: Column) -> Column:
    """A whole number of zero or more, else null."""
    number = strip(value.cast("string")).try_cast("bigint")
    return F.when(number >= 0, number)


def safe_float(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("double")


def pages(value: Column) -> Column:
    """A comma list to distinct whole numbers in order of appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: strip(x).try_cast("int")), lambda x: x >= 0))


def field(raw: Column, name: str) -> Column:
    other = ALIASES.get(name)
    value = F.element_at(raw, F.lit(name))
    return value if other is None else F.when(F.map_contains_key(raw, name), value).otherwise(F.element_at(raw, F.lit(other)))


def normalise(raw: Column) -> Column:
    """map<string,string> to a struct of core fields and the tail that is left."""
    return F.struct(
        safe_text(field(raw, "source_file")).alias("source_file"),
        safe_text(field(raw, "source_path")).alias("source_path"),
        safe_int(field(raw, "source_page")).alias("source_page"),
        pages(field(raw, "source_pages")).alias("source_pages"),
        safe_text(field(raw, "chunk_id")).alias("chunk_id"),
        safe_text(field(raw, "doc_type")).alias("doc_type"),
        safe_text(field(raw, "industry")).alias("industry"),
        safe_float(field(raw, "retrieval_score")).alias("retrieval_score"),
        F.map_filter(raw, lambda k, v: ~k.isin(CORE)).alias("extra"),
    )


def matches(raw: Column, wanted: dict[str, str]) -> Column:
    """Every wanted name has its value; names are those of the flat form (page, score, source)."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & F.element_at(raw, F.lit(name)).eqNullSafe(F.lit(value))
    return out


def flatten(meta: Column) -> Column:
    """Back to a flat map under the older spellings, nulls left out."""
    core = F.create_map(
        F.lit("source_file"), meta["source_file"], F.lit("source"), meta["source_path"], F.lit("page"), meta["source_page"].cast("string"),
        F.lit("source_pages"), F.nullif(F.array_join(meta["source_pages"].cast("array<string>"), ","), F.lit("")), F.lit("chunk_id"), meta["chunk_id"],
        F.lit("doc_type"), meta["doc_type"], F.lit("industry"), meta["industry"], F.lit("score"), meta["retrieval_score"].cast("string"),
    )
    return F.map_concat(F.map_filter(core, lambda k, v: v.isNotNull()), meta["extra"])


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))
