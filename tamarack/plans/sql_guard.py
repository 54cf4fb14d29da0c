"""Read-only SQL over registered tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statements that read: a prefix test, then Spark's own parser says what kind of statement it is.
READS = re.compile(r"\s*(select|with)\b", re.I)
FENCE = re.compile(r"```(?:sql)?\s*(.*?)```", re.I | re.S)


def extract(text: str) -> str:
    """SQL of an answer: its fenced block, else from its first SELECT or WITH, else all of it."""
    fenced = FENCE.search(text)
    if fenced:
        return fenced[1].strip().rstrip(";")
    start = re.search(r"\b(select|with)\b", text, re.I)
    return (text[start.start() :] if start else text).strip().rstrip(";")


def _writes(plan) -> bool:
    """Whether a parsed plan, or a part of it, is anything but a query: WITH may stand before an INSERT or MERGE."""
    kind = plan.getClass()
    while kind is not None:
        names = [kind.getSimpleName(), *(i.getSimpleName() for i in kind.getInterfaces())]
        if any(n.endswith("Command") or n.startswith("Insert") for n in names):
            return True
        kind = kind.getSuperclass()
    parts = plan.children()
    return any(_writes(parts.apply(i)) for i in range(parts.size()))


def check(spark: SparkSession, statement: str) -> str:
    """The statement if it is one query; ValueError else."""
    if not READS.match(statement) or _writes(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)):
        raise ValueError("only SELECT statements are allowed")
    return statement


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a guarded query, `tables` being the views it may name beside those of the session."""
    for name, frame in (tables or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(check(spark, extract(text)))
