"""One batch search: cache, ranked sources, fusion, filter, rerank, projection, and what each query went through."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import query_hash
from tamarack.operators import cache, retrieval
from tamarack.operators import query_cache as cached
from tamarack.operators.query_cache import Embedder, QueryCache
from tamarack.session import discard, written

#: (query_id, query) to query_id, chunk_id, rank.
Source = Callable[[DataFrame], DataFrame]
#: Candidates that go to the reranker, and results that it gives at least, before a query's own limit.
CANDIDATES, RERANKED = 12, 5


@dataclass
class Found:
    results: DataFrame  # query_id, rank, chunk_id, source_file, content
    trace: DataFrame  # query_id, stage, cache_hit, candidates, reranked, returned, top_score, degraded
    entries: DataFrame  # cache entries to add, in the columns of a QueryCache
    hits: DataFrame  # query_id, tier (exact or semantic), entry (its query_hash), similarity

    def close(self) -> None:
        """Delete the four tables from the shared folder, once nothing reads them."""
        discard([self.results, self.trace, self.entries, self.hits])


def _lists(asked: DataFrame, sources: dict[str, Source], scratch: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    """query_id, list_no, key, rank of every source that works, and the names of those that don't; none working is an error."""
    parts, failed = [], {}
    for number, (name, source) in enumerate(sources.items()):
        wanted = asked.where(F.col("mode").isin("hybrid", name)).select("query_id", "query")
        try:
            found = written(source(wanted).select("query_id", F.col("chunk_id").alias("key"), "rank"), f"list-{name}")
        except (PySparkException, OSError, RuntimeError, ValueError) as error:
            failed[name] = error
        else:
            scratch.append(found)
            parts.append(found.withColumn("list_no", F.lit(number)))
    if not parts:
        raise RuntimeError(f"no source works: {failed}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, [f"{name}_error" for name in failed]


def search(
    requests: DataFrame, chunks: DataFrame, sources: dict[str, Source], score: Callable[[pd.Series, pd.Series], pd.Series], k: int = 10, entries: DataFrame | None = None,
    now: str = "1970-01-01 00:00:00", threshold: float = 0.1, content_limit: int = 800, store: QueryCache | None = None, embed: Embedder | None = None,
) -> Found:
    """requests (query_id, query, top_k, mode, filters map<string,string>), chunks (chunk_id, content, source_file, meta map<string,string>).

    `sources` are named as the modes are; hybrid fuses all of them, 2k a query,
    and goes on with those that work. Filters apply after the fusion, so rows
    beyond it never move up. Live cache `entries`, or those of the persisted cache `store`, answer
    hybrid queries without filters: by hash first, then, with `embed`, the rest by the nearest
    vector at the cache's threshold. New answers are put into `store`. An embedder that fails costs the nearest lookup only.
    """
    plain = requests if "filters" in requests.columns else requests.withColumn("filters", F.lit(None).cast("map<string,string>"))
    asked = written(retrieval.requests(plain).withColumn("cacheable", (F.col("mode") == "hybrid") & F.col("filters").isNull()).withColumn("query_hash", query_hash(F.col("query"))), "requests")
    at = F.to_timestamp(F.lit(now))
    spark = requests.sparkSession
    held = store.live(at) if store else cached.complete(entries if entries is not None else spark.createDataFrame([], cached.SCHEMA)).where(F.col("expires_at") > at)
    held = written(held, "cache-entries")
    vectors = cached.embedded(asked.where("cacheable").select("query_id", "query"), embed)
    found_hits = written(cached.lookup(asked.where("cacheable"), held, vectors, store.threshold if store else cached.THRESHOLD), "cache-hits")
    scratch = [asked, held, vectors, found_hits]
    hits = found_hits.join(asked.select("query_id", "top_k"), "query_id").withColumnRenamed("top_score", "held_score")
    opened = asked.join(hits.select("query_id"), "query_id", "left_anti")

    lists, degraded = _lists(opened, sources, scratch)
    modes = opened.select("query_id", "mode", "top_k", "filters", "query", "query_hash", "cacheable")
    fused = retrieval.reciprocal_rank_fusion(lists, 2 * k).join(modes.where("mode = 'hybrid'").select("query_id"), "query_id", "left_semi")
    single = lists.join(modes.where("mode <> 'hybrid'").select("query_id"), "query_id", "left_semi")
    ranks = fused.select("query_id", "key", "rank").unionByName(single.select("query_id", "key", "rank"))
    known = chunks.select(F.col("chunk_id").alias("key"), "content", "source_file", "meta")
    fits = F.forall(F.map_entries("filters"), lambda e: F.element_at("meta", e["key"]).eqNullSafe(e["value"]))
    candidates = ranks.join(known, "key").join(modes, "query_id").where(F.col("filters").isNull() | fits)
    candidates = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key")))
    candidates = written(candidates.select("query_id", "query", "key", "rank", "content", "source_file", "top_k"), "candidates")
    best = retrieval.rerank(candidates, score, top_n=10, threshold=threshold, cap=CANDIDATES).where(F.col("position") <= F.greatest(F.col("top_k"), F.lit(RERANKED)))
    best = written(best.select("query_id", "key", "position", "score", "content", "source_file", "top_k"), "reranked")
    scratch += [candidates, best]

    replayed = hits.select("query_id", "top_k", F.posexplode("chunk_ids").alias("position", "key")).withColumn("position", F.col("position") + 1)
    replayed = replayed.join(known.drop("meta"), "key")
    names = ["query_id", F.col("position").alias("rank"), F.col("key").alias("chunk_id"), "source_file", "content", "top_k"]
    rows = best.select(*names).unionByName(replayed.select(*names)).where(F.col("rank") <= F.col("top_k")).drop("top_k")
    results = written(retrieval.project(rows, 10, content_limit), "results")

    met = candidates.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("rank") <= CANDIDATES).alias("reranked"))
    kept = best.groupBy("query_id").agg(F.max("score").alias("best_score"), F.array_sort(F.collect_list(F.struct("position", "key"))).alias("kept"))
    returned = results.groupBy("query_id").agg(F.count("*").alias("returned"))
    trace = asked.join(hits.select("query_id", "held_score"), "query_id", "left").join(met, "query_id", "left").join(kept, "query_id", "left").join(returned, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    prefix = F.when(F.col("mode") == "hybrid", "dual").otherwise(F.col("mode"))
    hit = F.col("held_score").isNotNull()
    # Names of the stages.
    stage = F.when(hit, "semantic_cache_hit").when(F.col("candidates").isNull(), F.concat(prefix, F.lit("_retrieve_empty"))).otherwise(F.concat(prefix, F.lit("_retrieve+rerank")))
    top_score = F.coalesce("held_score", "best_score", F.lit(0.0))
    trace = written(trace.withColumns({"stage": stage, "hit": hit, "top": top_score}), "search-trace")
    scratch.append(trace)
    added = trace.where(F.col("cacheable") & ~F.col("hit"))
    n = F.coalesce(F.size("kept"), F.lit(0))
    ids = F.coalesce(F.transform("kept", lambda x: x["key"].cast("string")), F.array().cast("array<string>"))
    expiry = at + F.make_interval(secs=cache.lifetime(F.greatest(n, F.lit(0))).cast("decimal(18,6)"))
    admitted = cache.admission(F.greatest(n, F.lit(0)), F.col("top"))
    added = added.where(admitted != "none").join(vectors, "query_id", "left").withColumn("vector", F.when(admitted == "both", F.col("embedding")))
    added = added.select("query_hash", "query", "vector", ids.alias("chunk_ids"), F.col("top").alias("top_score"), at.alias("inserted_at"), expiry.alias("expires_at"))
    added = written(added, "cache-added")
    if store:
        store.put(added, now)
    trace = trace.select(
        "query_id", "stage", F.col("hit").alias("cache_hit"), zero(F.col("candidates")).alias("candidates"), zero(F.col("reranked")).alias("reranked"),
        zero(F.col("returned")).alias("returned"), F.round("top", 6).alias("top_score"), F.lit(",".join(degraded)).alias("degraded"),
    )
    found = Found(results, written(trace, "trace"), added, written(hits.select("query_id", "tier", "entry", "similarity"), "hits"))
    discard(scratch)
    return found
