"""Scan, scalar and retrieval queries. Documents stand for chunks, benchmark items for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import metadata, text
from tamarack.operators import retrieval
from tamarack.session import documents, table
from tamarack.sources import readers

K = 10
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

INDEX_CTE = f"""
toks AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(coalesce(len({TERMS.format("text")}), 0)) AS avgdl FROM documents),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL)
"""
BM25_CTE = (
    INDEX_CTE
    + """,
sc AS (SELECT query_id, doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10),
ov AS (SELECT query_id, doc_id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
  FROM q JOIN tf USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 10)
"""
)
RRF_CTE = (
    BM25_CTE
    + """,
ls AS (SELECT query_id, 0 AS list_no, rank, doc_id FROM bm UNION ALL SELECT query_id, 1, rank, doc_id FROM ov),
fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS first FROM ls GROUP BY ALL),
rr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM fu QUALIFY rank <= 20)
"""
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a chunk store."""
    meta = F.to_json(F.struct(F.col("source").alias("source_file"), F.col("lang").alias("industry"), (F.col("n_chars") % 7).alias("page")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"), meta.alias("metadata_json"),
        F.lit("").alias("document_id"), F.col("doc_id").alias("seq"),
    )


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(questions(spark, sf_dir), documents(spark, sf_dir), K, epsilon=None)


def bm25_and_overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """BM25, and as a second ranked list how many distinct query terms a document has; both from one tokenization."""
    asked = questions(spark, sf_dir)
    counted = retrieval.counted_documents(documents(spark, sf_dir))
    return retrieval.score_postings(asked, counted, K, epsilon=None), retrieval.overlap_topk(asked, counted, K)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda frame, number: frame.select("query_id", F.lit(number).alias("list_no"), "rank", F.col("doc_id").alias("key"))
    first, second = bm25_and_overlap(spark, sf_dir)
    return retrieval.reciprocal_rank_fusion(pick(first, 0).unionByName(pick(second, 1)), 2 * K).withColumnRenamed("key", "doc_id")


def chunk_scan_paged(spark, sf_dir):
    rows = readers.scan_chunks(chunks(spark, sf_dir), "src3", limit=20, offset=5)
    return rows.select("chunk_id", "document_id", "seq", F.length("content").alias("chars"))


def json_predicate(spark, sf_dir):
    raw = F.from_json("props", "map<string,string>")
    rows = table(spark, sf_dir, "events").where(metadata.matches(raw, {"k": "3"}))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def metadata_normalise(spark, sf_dir):
    """Aliases, safe casts and page lists on maps made from documents."""
    raw = F.create_map(
        F.lit("source_file"), F.col("source"), F.lit("page"), (F.col("n_chars") % 9 - 1).cast("string"), F.lit("score"), (F.col("n_chars") / 7).cast("string"),
        F.lit("source_pages"), F.concat(F.lit("3,x,3,"), (F.col("n_chars") % 5).cast("string")), F.lit("lang"), F.col("lang"),
    )
    meta = metadata.normalise(raw)
    rows = table(spark, sf_dir, "documents").select("doc_id", meta.alias("m"))
    return rows.select(
        "doc_id", "m.source_file", F.col("m.source_page").alias("source_page"), F.array_join(F.col("m.source_pages").cast("array<string>"), ",").alias("source_pages"),
        F.round("m.retrieval_score", 6).alias("retrieval_score"), F.element_at("m.extra", F.lit("lang")).alias("lang"),
        F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(metadata.flatten(F.col("m")), lambda k, v: k != "score"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("flat"),
    )


def noise_filter(spark, sf_dir):
    from tamarack.operators.dataset import drop_noise

    return drop_noise(documents(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def text_functions(spark, sf_dir):
    """Numbers, sizes, trims and hashes of every text."""
    body = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(text.numbers(body)).alias("n_numbers"),
        F.array_join(F.slice(text.numbers(body), 1, 5), ",").alias("first_numbers"),
        text.token_estimate(body).alias("tokens"),
        text.trim_after(F.col("source"), 3).alias("after"),
        text.trim_within(F.col("source"), 4, "…").alias("within"),
        text.query_hash(F.concat(F.lit("  "), "source")).alias("query_hash"),
        text.case_id(F.array("source", "lang"), F.col("lang")).alias("case_id"),
        text.key_digest(F.col("source")).alias("key_digest"),
        text.has_table(body).alias("has_table"),
        F.round(text.share_of(body, "a-z"), 6).alias("lower_share"),
    )


def source_normalize(spark, sf_dir):
    raw = F.concat(F.lit("  ././"), F.upper("source"), F.lit("\\A/Doc"), F.col("doc_id").cast("string"), F.lit(".PDF "))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", raw.alias("raw"))
    return rows.select(
        "doc_id", text.normalise_source(F.col("raw")).alias("path"), text.base_name(F.col("raw")).alias("name"),
        text.same_source(F.col("raw"), F.concat(F.lit("a/doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("same"),
        text.display_source(F.lit(""), F.concat("source", F.lit("::7")), F.lit("x\\y")).alias("shown"),
    )


def table_heuristic(spark, sf_dir):
    """Numeric tables among texts made of numbers that the line items hold."""
    line = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.when(F.col("l_tax") > 0.04, F.lit("7")), F.col("l_returnflag"))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t"))))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("body"))
    return orders.select("l_orderkey", text.is_table_like(F.col("body")).alias("table_like"))


def bm25_stats(spark, sf_dir):
    posts = retrieval.postings(documents(spark, sf_dir), "doc_id", "text")
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def corpus_statistics(spark, sf_dir):
    return retrieval.corpus_statistics(documents(spark, sf_dir), "doc_id", "text").select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_floor(spark, sf_dir):
    """With negative idf values raised to a quarter of the mean."""
    found = retrieval.bm25_topk(questions(spark, sf_dir), documents(spark, sf_dir), 5)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_topk(asked, vectors, K).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir)


def post_filter(spark, sf_dir):
    """Filter after the cut: only English documents of the fused twenty stay, with their ranks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return retrieval.post_filter(fused(spark, sf_dir).join(docs, "doc_id"), F.col("lang") == "en").select("query_id", "doc_id", "score", "rank")


def degraded_retrieval(spark, sf_dir):
    """The lexical source failed: its list is empty and the other alone is fused."""
    lists = bm25_and_overlap(spark, sf_dir)[1].select("query_id", F.lit(1).alias("list_no"), "rank", F.col("doc_id").alias("key"))
    return retrieval.reciprocal_rank_fusion(lists, 2 * K).withColumnRenamed("key", "doc_id")


def _shared_length(queries, contents):
    """A stand-in model: the shorter length over the longer."""
    a, b = queries.str.len().astype(float), contents.str.len().astype(float)
    return a.combine(b, min) / a.combine(b, max)


def rerank_threshold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    rows = fused(spark, sf_dir).drop("score").join(docs, "doc_id").join(questions(spark, sf_dir), "query_id")
    best = retrieval.rerank(rows, _shared_length, top_n=5)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("position").alias("rank"))


def result_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("source_file"))
    rows = fused(spark, sf_dir).join(docs, "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string"))
    return retrieval.project(rows, 5).select("query_id", "rank", "chunk_id", "source_file", F.length("content").alias("chars"), F.md5("content").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_scan_paged, json_predicate, metadata_normalise, noise_filter, text_functions, source_normalize, table_heuristic, bm25_stats, corpus_statistics,
        bm25_topk, bm25_floor, vector_topk, rrf_fusion, post_filter, degraded_retrieval, rerank_threshold, result_projection,
    )
}

ORACLES = {
    "chunk_scan_paged": "SELECT 'c' || doc_id AS chunk_id, 'c' || doc_id AS document_id, doc_id AS seq, length(text) AS chars FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20 OFFSET 5",
    "json_predicate": "SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') = '3' GROUP BY ALL",
    "metadata_normalise": """SELECT doc_id, source AS source_file, CASE WHEN n_chars % 9 - 1 >= 0 THEN n_chars % 9 - 1 END AS source_page,
      CASE WHEN n_chars % 5 = 3 THEN '3' ELSE '3,' || (n_chars % 5) END AS source_pages, round(n_chars / 7.0, 6) AS retrieval_score, lang,
      'lang=' || lang || CASE WHEN n_chars % 9 - 1 >= 0 THEN ';page=' || (n_chars % 9 - 1) ELSE '' END || ';source_file=' || source || ';source_pages=' || CASE WHEN n_chars % 5 = 3 THEN '3' ELSE '3,' || (n_chars % 5) END AS flat FROM documents""",
    "noise_filter": """SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE length(trim(text, '@BLANK@')) >= 100
      AND NOT regexp_matches(substr(text, 1, 600), '免责声明|分析师声明|评级说明|执业编号|证券投资咨询业务资格') GROUP BY source""",
    "text_functions": r"""WITH n AS (SELECT *, regexp_extract_all(lower(regexp_replace(text, '[\s,，]', '', 'g')), '\d+(?:\.\d+)?%?') AS found FROM documents),
      u AS (SELECT doc_id, list_distinct(found) AS d, found FROM n),
      o AS (SELECT doc_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS ordered FROM u)
      SELECT doc_id, len(ordered) AS n_numbers, array_to_string(ordered[1:5], ',') AS first_numbers, (strlen(text) + 1) // 2 AS tokens,
      CASE WHEN length(source) > 3 THEN rtrim(substr(source, 1, 3)) || '...' ELSE source END AS "after",
      CASE WHEN length(source) > 4 THEN rtrim(substr(source, 1, 3)) || '…' ELSE source END AS "within",
      sha256(lower(source)) AS query_hash, 'rag_' || substr(sha256(source || '|' || lang || chr(0) || lang), 1, 16) AS case_id,
      substr(sha256(source), 1, 24) AS key_digest, regexp_matches(text, '(?m)^\s*\|.+\|\s*$') AS has_table,
      CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^a-z]', '', 'g')) / length(text), 6) END AS lower_share
      FROM n JOIN o USING (doc_id)""",
    "source_normalize": """SELECT doc_id, lower(source) || '/a/doc' || doc_id || '.pdf' AS path, 'doc' || doc_id || '.pdf' AS name, true AS same, source AS shown FROM documents""",
    "table_heuristic": r"""WITH l AS (SELECT l_orderkey, l_linenumber, 2 + CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS k FROM lineitem)
      SELECT l_orderkey, count_if(k >= 3) >= 3 AND count_if(k >= 3) / count(*) >= 0.12 AS table_like FROM l GROUP BY ALL""",
    "bm25_stats": f"WITH {INDEX_CTE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM tf GROUP BY ALL",
    "corpus_statistics": f"SELECT count(*) AS n_docs, sum(len({TERMS.format('text')}))::BIGINT AS n_tokens, round(avg(len({TERMS.format('text')})), 6) AS avgdl FROM documents",
    "bm25_topk": f"WITH {BM25_CTE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm",
    "bm25_floor": f"""WITH {INDEX_CTE}, mi AS (SELECT avg(ln((n - df + 0.5) / (df + 0.5))) AS mean FROM df, st),
      sc AS (SELECT query_id, doc_id, round(sum(qf * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN 0.25 * mean ELSE ln((n - df + 0.5) / (df + 0.5)) END)
        * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st, mi GROUP BY ALL)
      SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sc.score DESC, doc_id) <= 5""",
    "vector_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
      s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS raw FROM v a, v b WHERE a.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM s)
      SELECT query_id, vec_id, round(raw, 6) AS score, rank FROM r WHERE rank <= 10""",
    "rrf_fusion": f"WITH {RRF_CTE} SELECT query_id, doc_id, score, rank FROM rr",
    "post_filter": f"WITH {RRF_CTE} SELECT query_id, doc_id, score, rank FROM rr JOIN documents USING (doc_id) WHERE lang = 'en'",
    "degraded_retrieval": f"WITH {BM25_CTE} SELECT query_id, doc_id, round(1.0 / (60 + rank), 9) AS score, rank FROM ov",
    "rerank_threshold": f"""WITH {RRF_CTE}, p AS (SELECT query_id, rr.doc_id, rank, least(length(d.text), length(b.text)) / greatest(length(d.text), length(b.text)) AS s
        FROM rr JOIN documents d ON rr.doc_id = d.doc_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 12),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS position FROM p)
      SELECT query_id, doc_id, round(s, 6) AS score, position AS rank FROM o WHERE s > 0.1 AND position <= 5""",
    "result_projection": f"""WITH {RRF_CTE}, t AS (SELECT query_id, rank, doc_id, source, trim(text, '@BLANK@') AS c FROM rr JOIN documents USING (doc_id) WHERE rank <= 5 AND length(trim(text, '@BLANK@')) > 0),
      x AS (SELECT *, CASE WHEN length(c) > 800 THEN rtrim(substr(c, 1, 800), '@BLANK@') || '...' ELSE c END AS y FROM t)
      SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS chunk_id, source AS source_file, length(y) AS chars, md5(y) AS digest FROM x""",
}
