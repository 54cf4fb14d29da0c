"""Markdown, scans and tables of files against plain rules."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import dataset
from tamarack.sources import writers


def test_tables_of_cells(spark):
    tables = [None, [], [[]], [["a", None], ["x"], ["1", " 2\n3 ", "4"]], [["only"]]]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, t array<array<string>>").select("i", text.table_markdown(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == ["", "", "", "| a |  |\n| --- | --- |\n| x |  |\n| 1 | 2 3 |", "| only |\n| --- |"]


def _document(title, facts, sections):
    lines = [f"# {title}\n"]
    if facts:
        lines += ["---", *(f"**{k}**：{v}" for k, v in facts), "---\n"]
    for level, heading, content, bullets, headers, rows in sections or []:
        lines += [f"{'#' * (level or 2)} {heading}\n"] if heading else []
        lines += [f"{content}\n"] if content else []
        lines += [*(f"- {b}" for b in bullets), ""] if bullets else []
        if headers:
            cell = lambda c: (c or "").replace("|", "\\|")
            cut = [[*r, *[""] * len(headers)][: len(headers)] for r in rows or []]
            lines += [f"| {' | '.join(map(cell, headers))} |", f"| {' | '.join(['---'] * len(headers))} |", *(f"| {' | '.join(map(cell, r))} |" for r in cut), ""]
    return "\n".join(lines)


def test_documents_of_sections(spark):
    cases = [
        ("t", None, None), ("t", [("k", "v"), ("l", "w")], []),
        ("t", [], [(3, "h", "c", ["a", "b"], ["x|", "y"], [["1"], ["1", None, "3"], ["p|q", "r"]]), (None, "", None, [], None, [["1"]]), (1, "z", "", None, ["x"], None)]),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, title string, facts array<struct<name:string,value:string>>, sections {text.SECTIONS}")
    got = frame.select("i", text.markdown_document(F.col("title"), F.col("facts"), F.col("sections")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [_document(*c) for c in cases]


def test_scans(spark):
    pages = [
        ("empty", None, 1), ("scan", "x" * 99, 0), ("part", "中" * 400, 0), ("part", " ", 2), ("garbled", "a" * 95 + "中" * 5, 0), ("good", "a" * 80 + "中" * 20, None), ("half", "中" * 250, 0), ("half", "中" * 20, 1), ("half", "中" * 250, 1),
    ]
    got = {r.doc_id: r for r in dataset.scan_quality(spark.createDataFrame(pages, "doc_id string, text string, images int")).collect()}
    assert {k: r.issues for k, r in got.items()} == {
        "empty": [dataset.SCAN], "scan": [dataset.SCAN], "part": ["部分扫描(50%页为图片)"], "garbled": ["疑似乱码(中文仅占5.0%)"], "good": [], "half": ["部分扫描(33%页为图片)"],
    }
    assert (got["part"].total_chars, got["part"].avg_chars, got["part"].image_ratio, got["garbled"].cjk_ratio, got["empty"].cjk_ratio) == (401, 200, 0.5, 0.05, 0.0)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_tables_are_stamped_overwritten_or_appended(spark, tmp_path, kind):
    rows, at = spark.createDataFrame([("1", "x")], "a string, b string"), f"file://{tmp_path}/{kind}"
    read = lambda path: sorted(tuple(r) for r in spark.read.format(kind).options(header=True).load(path).collect())
    now = dt.datetime(2026, 1, 2, 3, 4, 5)
    stamped = writers.write_table(rows, at, kind=kind, now=now)
    assert re.search(r"_20260102_030405$", stamped) and read(stamped) == [("1", "x")]
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_table(rows, at, kind=kind, now=now)
    for n in (1, 2):
        assert writers.write_table(rows, at, "append", kind) == at and len(read(at)) == n
    with pytest.raises(ValueError):
        writers.write_table(rows.select("b", "a"), at, "append", kind)
    writers.write_table(rows, at, "overwrite", kind)
    assert read(at) == [("1", "x")]
    with pytest.raises(ValueError):
        writers.write_table(rows, at, "other", kind)
