"""Queries over persisted stores: versions of a chunk store, the query cache, the vector store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import query_cache, search, vector_store
from tamarack.operators.retrieval import vector_topk
from tamarack.session import checkpoint_folder, table, written
from tamarack.sources.writers import ChunkStore

NOON = "2024-01-01 12:00:00"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store_versions(spark, sf_dir):
    """Open orders loaded, urgent ones put in at twice their price, building customers dropped: what each version holds."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus", "o_orderpriority")
    store = ChunkStore(spark, _folder(spark, "orders"), "chunk_id string, custkey bigint, price double", buckets=16, place="custkey")
    store.replace_all(orders.where("o_orderstatus = 'O'"))
    store.upsert(orders.where("o_orderpriority = '1-URGENT'").withColumn("price", 2 * F.col("price")))
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    store.upsert(orders.limit(0), drop=("custkey", building))
    versions = [store.read(v).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price")).select(F.lit(v).alias("version"), "n", "price") for v in (1, 2, 3)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id is not null")


def _question(n) -> F.Column:
    return F.concat(F.lit("question "), n.cast("string"))


def search_semantic(spark, sf_dir):
    """Every vector is asked about; those of labels under 3 were asked before. Hits by hash, hits by the nearest vector, and searches of the rest."""
    rows = _vectors(spark, sf_dir)
    asked = rows.select(F.col("vec_id").alias("query_id"), _question(F.col("vec_id")).alias("query"), F.lit(5).alias("top_k"), F.lit(None).cast("string").alias("mode"))
    before = rows.where("label < 3").select(
        text.query_hash(_question(F.col("vec_id"))).alias("query_hash"), _question(F.col("vec_id")).alias("query"), F.col("embedding").alias("vector"), F.array(F.col("vec_id").cast("string")).alias("chunk_ids"),
        F.lit(0.9).alias("top_score"), F.timestamp_seconds(1704067200 + F.col("vec_id")).alias("inserted_at"), F.to_timestamp(F.lit("2024-02-01")).alias("expires_at"),
    )
    held = query_cache.QueryCache(spark, _folder(spark, "query-cache"), capacity=1_000_000)
    held.put(before, NOON)
    embed = lambda queries: queries.join(rows.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    nearest = lambda queries: vector_topk(embed(queries), rows.select("vec_id", "embedding"), 5).select("query_id", F.col("vec_id").cast("string").alias("chunk_id"), "rank")
    chunks = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"), F.lit("s").alias("source_file"), F.create_map(F.lit("k"), F.lit("v")).alias("meta"))
    found = search.search(asked, chunks, {"vector": nearest}, lambda queries, contents: queries.str.len() * 0 + 0.4, 5, now=NOON, store=held, embed=embed)
    rest = found.trace.join(found.hits, "query_id", "left")
    return rest.select("query_id", "stage", "tier", F.col("entry"), F.round("similarity", 6).alias("similarity"), "returned", F.lit(held.store.version()).alias("version"))


def cache_store(spark, sf_dir):
    """The cache after two puts: orders' comments of two days, the first day expired in part, the semantic tier cut back to its capacity."""
    rows = _vectors(spark, sf_dir)
    entry = rows.select(
        text.query_hash(_question(F.col("vec_id"))).alias("query_hash"), _question(F.col("vec_id")).alias("query"), F.when(F.col("label") != 9, F.col("embedding")).alias("vector"),
        F.array(F.col("label").cast("string")).alias("chunk_ids"), F.lit(0.9).alias("top_score"), "vec_id", "label",
    )
    first = entry.where("label < 5").withColumns({"inserted_at": F.timestamp_seconds(1704067200 + F.col("vec_id")), "expires_at": F.when(F.col("label") == 0, F.to_timestamp(F.lit("2024-01-01 06:00:00"))).otherwise(F.to_timestamp(F.lit("2024-01-03")))})
    second = entry.where("label >= 4").withColumns({"inserted_at": F.timestamp_seconds(1704110400 + F.col("vec_id")), "expires_at": F.to_timestamp(F.lit("2024-01-04"))})
    held = query_cache.QueryCache(spark, _folder(spark, "query-cache"), capacity=40)
    held.put(first, "2024-01-01 05:00:00")
    held.put(second, NOON)
    kept = written(held.live(F.to_timestamp(F.lit(NOON))), "cached")
    return kept.select("query", F.col("vector").isNotNull().alias("semantic"), F.array_join("chunk_ids", ",").alias("chunk_ids"), F.unix_timestamp("inserted_at").alias("inserted"))


def vector_index_topk(spark, sf_dir):
    """A store of all vectors, those of label 0 then turned about and those of label 1 deleted; every hundredth vector asks all cells."""
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding", "label")
    held = vector_store.VectorStore(spark, _folder(spark, "vectors"))
    held.build(rows, 16)
    turned = rows.where("label = 0").select("vec_id", F.transform("embedding", lambda v: -v).alias("embedding"))
    held.upsert(turned.unionByName(rows.where("label = 1").select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = held.search(asked, 10, probes=16)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (store_versions, search_semantic, cache_store, vector_index_topk)}

ORACLES = {
    "vector_index_topk": """WITH v AS (SELECT vec_id, CASE WHEN label = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id IS NOT NULL AND label <> 1),
      s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.e), 9) AS s FROM embeddings q JOIN v ON true WHERE q.vec_id % 100 = 0)
      SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "store_versions": """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice AS p FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT o_orderkey, o_custkey, 2 * o_totalprice AS p FROM orders WHERE o_orderpriority = '1-URGENT'),
      b AS (SELECT * FROM a ANTI JOIN u USING (o_orderkey) UNION ALL SELECT * FROM u), c AS (SELECT * FROM b WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
      SELECT 1 AS version, count(*) AS n, round(sum(p), 2)::DOUBLE AS price FROM a UNION ALL SELECT 2, count(*), round(sum(p), 2)::DOUBLE FROM b UNION ALL SELECT 3, count(*), round(sum(p), 2)::DOUBLE FROM c""",
    "search_semantic": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id IS NOT NULL),
      n AS (SELECT q.vec_id, h.vec_id AS held, round(list_cosine_similarity(q.e, h.e), 9) AS s FROM v q JOIN v h ON h.label < 3 WHERE q.label >= 3),
      b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, held) = 1 AND s >= 0.92)
      SELECT v.vec_id AS query_id, CASE WHEN v.label < 3 OR b.held IS NOT NULL THEN 'semantic_cache_hit' ELSE 'dual_retrieve+rerank' END AS stage,
        CASE WHEN v.label < 3 THEN 'exact' WHEN b.held IS NOT NULL THEN 'semantic' END AS tier, CASE WHEN v.label < 3 OR b.held IS NOT NULL THEN sha256('question ' || coalesce(b.held, v.vec_id)) END AS entry,
        CASE WHEN v.label < 3 THEN 1.0 ELSE round(b.s, 6) END AS similarity, CASE WHEN v.label < 3 OR b.held IS NOT NULL THEN 1 ELSE 5 END AS returned, 1 + 1 AS version FROM v LEFT JOIN b USING (vec_id)""",
    "cache_store": """WITH a AS (SELECT vec_id, label, label <> 9 AS s, 1704067200 + vec_id AS t, row_number() OVER (PARTITION BY label <> 9 ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label <> 9) AS n FROM embeddings WHERE label < 5),
      f AS (SELECT vec_id, label, s AND k > CASE WHEN n > 40 THEN ((n - 40 + 3) // 4) * 4 ELSE 0 END AS s, t FROM a),
      m AS (SELECT vec_id, label, s, t FROM f WHERE label BETWEEN 1 AND 3 UNION ALL SELECT vec_id, label, label <> 9, 1704110400 + vec_id FROM embeddings WHERE label >= 4),
      c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, sha256('question ' || vec_id)) AS k, count(*) OVER (PARTITION BY s) AS n FROM m)
      SELECT 'question ' || vec_id AS query, s AND k > CASE WHEN n > 40 THEN ((n - 40 + 3) // 4) * 4 ELSE 0 END AS semantic, CAST(label AS VARCHAR) AS chunk_ids, t AS inserted FROM c""",
}
