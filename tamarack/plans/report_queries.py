"""Queries over Markdown tables and documents, and the state of scanned documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import dataset
from tamarack.session import documents, table


def _lines(spark, sf_dir):
    """The lines of each order, in order, as cells; every third line is short, every fifth long."""
    n = F.col("l_linenumber")
    mode = F.concat(F.lit("mode"), (F.col("l_partkey") % 7).cast("string"))
    cells = F.array(F.concat(F.lit(" part "), "l_partkey"), mode, F.when(n % 2 == 0, F.concat("l_returnflag", F.lit("|\n "), "l_linestatus")))
    row = F.when(n % 3 == 0, F.slice(cells, F.lit(1), F.lit(2))).when(n % 5 == 0, F.concat(cells, F.array(F.lit("more")))).otherwise(cells)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mode.alias("mode"), "l_returnflag", "l_linestatus", row.alias("row"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "mode", "row")
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("lines")).select("l_orderkey", F.col("lines.row").alias("rows"), F.col("lines.mode").alias("modes"))


def markdown_tables(spark, sf_dir):
    """The lines of each order as a table, a header before them but for every seventh order."""
    head = F.array(F.lit("part"), F.lit("ship\n mode"), F.lit(None).cast("string"))
    rows = _lines(spark, sf_dir).select("l_orderkey", F.when(F.col("l_orderkey") % 7 > 0, F.concat(F.array(head), "rows")).otherwise(F.array().cast("array<array<string>>")).alias("cells"))
    return rows.select("l_orderkey", text.table_markdown(F.col("cells")).alias("markdown"))


def markdown_report(spark, sf_dir):
    """Each order as a document: facts for even ones, ship modes as a list, lines as a table but for every third order."""
    n = F.col("l_orderkey")
    key = n.cast("string")
    section = lambda level, heading, content, bullets, headers, rows: F.struct(level.alias("level"), heading.alias("heading"), content.alias("content"), bullets.alias("bullets"), headers.alias("headers"), rows.alias("rows"))
    no_list, no_rows = F.lit(None).cast("array<string>"), F.lit(None).cast("array<array<string>>")
    first = section(F.lit(None).cast("int"), F.lit("Modes"), F.when(n % 4 > 0, F.concat(F.lit("Of order "), key)), F.col("modes"), no_list, no_rows)
    second = section(F.lit(3), F.when(n % 5 > 0, "Lines"), F.lit(""), no_list, F.when(n % 3 > 0, F.array(F.lit("part"), F.lit("mode|"), F.lit("flag"))), F.col("rows"))
    facts = F.when(n % 2 == 0, F.array(F.struct(F.lit("order").alias("name"), key.alias("value")), F.struct(F.lit("lines").alias("name"), F.size("rows").cast("string").alias("value"))))
    rows = _lines(spark, sf_dir)
    return rows.select("l_orderkey", text.markdown_document(F.concat(F.lit("Order "), key), facts, F.array(first, second)).alias("markdown"))


def document_scan(spark, sf_dir):
    """The lines of documents as pages, every third with an image; e with an accent stands for a CJK character in every second document."""
    cjk = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("é"), F.lit("中"))).otherwise(F.col("text"))
    pages = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce(cjk, F.lit("")), "\n")).alias("page", "text")).withColumn("images", (F.col("page") % 3 == 0).cast("int"))
    rows = dataset.scan_quality(pages)
    return rows.withColumn("issues", F.array_join("issues", ","))


QUERIES = {f.__name__: f for f in (markdown_tables, markdown_report, document_scan)}

_LINES = """l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_suppkey, 'mode' || (l_partkey % 7) AS mode, l_returnflag AS r, l_linestatus AS s, ' part ' || l_partkey AS c1, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber % 3 > 0 THEN l_returnflag || '|' || chr(10) || ' ' || l_linestatus ELSE '' END AS c3 FROM lineitem)"""
_ORDER = "ORDER BY n, l_partkey, l_suppkey, r, s"

ORACLES = {
    "markdown_tables": rf"""WITH {_LINES}, t AS (SELECT l_orderkey, string_agg('| ' || trim(c1) || ' | ' || mode || ' | ' || replace(c3, chr(10) || ' ', ' ') || ' |', chr(10) {_ORDER}) AS body FROM l GROUP BY l_orderkey)
      SELECT l_orderkey, CASE WHEN l_orderkey % 7 > 0 THEN concat_ws(chr(10), '| part | ship mode |  |', '| --- | --- | --- |', body) ELSE '' END AS markdown FROM t""",
    "markdown_report": rf"""WITH {_LINES}, t AS (SELECT l_orderkey, l_orderkey AS o, count(*) AS lines, string_agg('- ' || mode, chr(10) {_ORDER}) AS modes, string_agg('| ' || c1 || ' | ' || mode || ' | ' || replace(c3, '|', '\|') || ' |', chr(10) {_ORDER}) AS body FROM l GROUP BY l_orderkey)
      SELECT l_orderkey, '# Order ' || o || chr(10) || CASE WHEN o % 2 = 0 THEN chr(10) || '---' || chr(10) || '**order**：' || o || chr(10) || '**lines**：' || lines || chr(10) || '---' || chr(10) ELSE '' END || chr(10) || '## Modes' || chr(10) || chr(10)
        || CASE WHEN o % 4 > 0 THEN 'Of order ' || o || chr(10) || chr(10) ELSE '' END || modes || chr(10) || CASE WHEN o % 5 > 0 THEN chr(10) || '### Lines' || chr(10) ELSE '' END
        || CASE WHEN o % 3 > 0 THEN chr(10) || '| part | mode\| | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || chr(10) ELSE '' END AS markdown FROM t""",
    "document_scan": """WITH d AS (SELECT doc_id, unnest(string_split(coalesce(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'é', '中') ELSE text END, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS page FROM documents),
      s AS (SELECT doc_id, count(*) AS pages, sum(length(t))::BIGINT AS total_chars, sum(length(regexp_replace(t, '[^一-鿿]', '', 'g'))) AS c, count(*) FILTER (length(trim(t, '@BLANK@')) < 50 AND page % 3 = 0) AS i FROM d GROUP BY doc_id),
      r AS (SELECT *, CASE WHEN total_chars > 0 THEN c / total_chars ELSE 0.0::DOUBLE END AS share, i / pages AS image, total_chars < 100 * pages AS scan FROM s)
      SELECT doc_id, pages, total_chars, total_chars // pages AS avg_chars, round(share, 4) AS cjk_ratio, round(image, 4) AS image_ratio,
        concat_ws(',', CASE WHEN scan THEN '全量扫描版' END, CASE WHEN NOT scan AND image > 0.3 THEN '部分扫描(' || round(image * 100)::INT || '%页为图片)' END, CASE WHEN NOT scan AND total_chars >= 50 AND share < 0.1 THEN printf('疑似乱码(中文仅占%.1f%%)', round(share * 100, 1)) END) AS issues FROM r""",
}
