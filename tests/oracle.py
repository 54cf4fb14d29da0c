"""Run a query's SQL in DuckDB and hold its rows against Spark's."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """One view for each table of the folder."""
    con = duckdb.connect()
    con.execute("SET threads = 2")
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def cell(value) -> str:
    """A value's text: whole and decimal numbers, floats and times read alike in both engines."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 10**9 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(cell, value)) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(frame, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if both agree in columns and rows, else the first rows on either side alone."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    got = rows_of(frame.columns, frame.collect())
    if got == want:
        return ""
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; Spark alone {len(only_got)}: {sorted(only_got)[:3]}; SQL alone {len(only_want)}: {sorted(only_want)[:3]}"
