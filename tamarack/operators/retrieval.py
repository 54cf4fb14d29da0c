"""Batch retrieval: lexical index, BM25, vector search, rank fusion, filtering, reranking."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import strip, tokens, trim_after
from tamarack.session import discard, written
from tamarack.sources.commits import CommitLog, StaleWrite

#: A text column to its list of terms, such as `tokens` or `search_tokens`.
Tokenizer = Callable[[Column], Column]
#: Scores are compared to nine places, so that a sum's order can't decide a rank.
PLACES = 9
#: Tokens counted at a time.
COUNTED_TOKENS = 1_000_000


def postings(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """doc, term, tf, dl: one row for each distinct term of a document."""
    long = _listed(docs, key, text, tokenizer).select("doc", "dl", F.explode("terms").alias("term"))
    return long.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf"))


def _listed(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer) -> DataFrame:
    """doc, terms, dl. The list goes through a generator of one row, so that no later column works it out again."""
    found = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>"))
    rows = docs.select(F.col(key).alias("doc"), F.explode(F.array(found)).alias("terms"))
    return rows.select("doc", "terms", F.size("terms").alias("dl"))


def corpus_statistics(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """One row: n_docs, n_tokens, avgdl."""
    return _statistics(_listed(docs, key, text, tokenizer).select(F.col("dl").cast("long").alias("dl")))


def _statistics(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _wanted(queries: DataFrame, query: tuple[str, str], tokenizer: Tokenizer) -> DataFrame:
    """query_id, term, qf."""
    long = queries.select(F.col(query[0]).alias("query_id"), F.explode(tokenizer(F.col(query[1]))).alias("term"))
    return long.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def counted_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """doc, dl, n_terms, terms, tfs: a row of `docs` each, with its distinct terms and how often it has them.

    Texts are tokenized once and counted where they are read, without a shuffle;
    the rows are written, since scores read them more than once.
    """
    listed = _listed(docs, key, text, tokenizer).select("doc", F.col("dl").cast("long").alias("dl"), "terms")
    kind = listed.schema["doc"].dataType.simpleString()
    return written(listed.mapInArrow(_counted, f"doc {kind}, dl bigint, n_terms int, terms array<string>, tfs array<int>"), "counted-documents")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(batch.column(1).to_numpy())
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COUNTED_TOKENS, "right")))
            rows = batch.slice(begin, end - begin)
            begin = end
            coded = rows.column(2).flatten().dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            own = np.repeat(np.arange(rows.num_rows), rows.column(1).to_numpy())
            found, tfs = np.unique(own * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            starts = np.searchsorted(found, np.arange(rows.num_rows + 1) * kinds)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
            parts = [rows.column(0), rows.column(1), pa.array(np.diff(starts), pa.int32()), lists(coded.dictionary.take(pa.array(found % kinds))), lists(pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(parts, ["doc", "dl", "n_terms", "terms", "tfs"])


def document_frequencies(counted: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """term, df: documents that have it, of the `vocabulary` (term) alone if given. Rows of one key are one document."""
    pairs = counted.select("doc", F.explode("terms").alias("term"))
    if vocabulary is not None:
        pairs = pairs.join(vocabulary, "term", "left_semi")
    repeated = counted.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    again = pairs.join(repeated, "doc", "left_semi").groupBy("doc", "term").agg((1 - F.count("*")).alias("df")).select("term", "df")
    return pairs.groupBy("term").agg(F.count("*").alias("df")).unionByName(again).groupBy("term").agg(F.sum("df").alias("df"))


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float | None = 0.25,
    query: tuple[str, str] = ("query_id", "query"), doc: tuple[str, str] = ("doc_id", "text"), tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of positive score, ties by id.

    Okapi BM25 over all query tokens, repeats included. Negative idf values
    become `epsilon` times the mean idf of all terms, which needs the document frequencies of
    the whole vocabulary; with None they stay, and only the queries' terms are counted.
    """
    return score_postings(queries, counted_documents(docs, *doc, tokenizer), k, k1, b, epsilon, query, tokenizer)


def score_postings(
    queries: DataFrame, counted: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float | None = 0.25,
    query: tuple[str, str] = ("query_id", "query"), tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """BM25 from documents as `counted_documents` gives them."""
    wanted = _wanted(queries, query, tokenizer)
    whole = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = whole.n_docs, whole.avgdl or 1.0
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if epsilon is None:
        met = document_frequencies(counted, wanted.select("term").distinct())
    else:
        met = written(document_frequencies(counted), "document-frequencies")
        mean = met.agg(F.avg(idf)).first()[0] or 0.0
        idf = F.when(idf < 0, epsilon * mean).otherwise(idf)
    weights = wanted.join(met, "term").select("query_id", "term", (F.col("qf") * idf).alias("weight"))
    return _best_documents(weights, counted, k, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))


def overlap_topk(queries: DataFrame, counted: DataFrame, k: int, query: tuple[str, str] = ("query_id", "query"), tokenizer: Tokenizer = tokens) -> DataFrame:
    """The k documents with the most distinct query terms."""
    weights = _wanted(queries, query, tokenizer).select("query_id", "term", F.lit(1.0).alias("weight"))
    return _best_documents(weights, counted, k, lambda tf, dl: np.ones(len(tf)))


def _best_documents(weights: DataFrame, counted: DataFrame, k: int, gain: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 1_024, shard: int = 1_000_000) -> DataFrame:
    """query_id, doc_id, score, rank: the k best sums of weight (query_id, term, weight) times gain(tf, dl), above zero, ties by id.

    Queries are dealt to blocks of about `block`, documents to shards of about
    `shard` postings, and each block meets each shard in one task, which gives k rows a
    query. So no row of a query and a document, which are nearly as many as all such pairs, leaves its task.
    """
    weights = written(weights, "query-weights")
    blocks = max(1, -(-weights.select("query_id").distinct().count() // block))
    shards = max(1, -(-(counted.agg(F.sum("n_terms")).first()[0] or 0) // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = weights.withColumn("block", deal("query_id", blocks)).withColumn("shard", every(shards))
    right = counted.where("n_terms > 0").select("doc", "dl", "terms", "tfs").withColumn("shard", deal("doc", shards)).withColumn("block", every(blocks))
    kinds = f"query_id {weights.schema['query_id'].dataType.simpleString()}, doc_id {counted.schema['doc'].dataType.simpleString()}, score double"
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(best_rows(k, gain), kinds)
    return ranked(found, k)


def best_rows(k: int, gain: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int = 1 << 20) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two tables, (query_id, term, weight) and (doc, dl, terms, tfs): the k best of the second for each query of the first."""

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        names, ids = _coded(one.column("query_id"))
        vocabulary, terms = _coded(one.column("term"))
        docs, own = _coded(other.column("doc"))
        order = pc.array_sort_indices(docs).to_numpy()  # ties fall to the least id
        docs, place = docs.take(pa.array(order)), np.argsort(order)
        own = place[own] if len(own) else own
        dl = np.bincount(own, other.column("dl").to_numpy(), len(docs))
        lists = other.column("terms").combine_chunks()
        at = pc.index_in(lists.flatten(), value_set=vocabulary)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        rows = np.repeat(own, pc.list_value_length(lists).to_numpy(zero_copy_only=False))[known]
        key = rows * len(vocabulary) + at.drop_null().to_numpy()
        # Rows of one key are one document.
        key, back = np.unique(key, return_inverse=True)
        tf = np.bincount(back, other.column("tfs").combine_chunks().flatten().to_numpy()[known], len(key))
        rows, codes = np.divmod(key, max(1, len(vocabulary)))
        gains = gain(tf, dl[rows])
        present, starts = np.unique(rows, return_index=True)
        starts = np.append(starts, len(rows))
        values = one.column("weight").to_numpy()
        parts = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
        for first in range(0, len(names), 256):
            inside = (ids >= first) & (ids < first + 256)
            width = min(256, len(names) - first)
            matrix = np.zeros((len(vocabulary), width))
            matrix[terms[inside], ids[inside] - first] = values[inside]
            least = np.zeros(width)  # a later document must be above it
            begin = 0
            while begin < len(present):
                end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + cells // width, "right")) - 1)
                span = slice(starts[begin], starts[end])
                sums = np.round(np.add.reduceat(matrix[codes[span]] * gains[span, None], starts[begin:end] - starts[begin], axis=0), PLACES)
                row, column = np.nonzero(sums > least)
                found = _first(column, sums[row, column], row, k)
                parts.append((column[found] + first, present[begin + row[found]], sums[row[found], column[found]]))
                if end - begin >= k:
                    least = np.maximum(least, np.partition(sums, end - begin - k, axis=0)[end - begin - k])
                begin = end
        column, row, total = (np.concatenate(p) for p in zip(*parts))
        best = _first(column, total, row, k)
        return pa.table([names.take(pa.array(column[best])), docs.take(pa.array(row[best])), pa.array(total[best])], ["query_id", "doc_id", "score"])

    return score


def _first(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k greatest values, the least tie first."""
    order = np.lexsort((tie, -value, group))
    begin = np.searchsorted(group[order], group[order], "left")
    return order[np.arange(len(order)) - begin < k]


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and the place among them of each row's."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class LexicalIndex:
    """Counted documents on disk, for each fingerprint of corpus version and tokenizer.

    A reader pins the fingerprint it asks for; an index of another version is no
    match and is built anew. A build is saved as the next generation after the one it
    began with: if the index was cleared meanwhile, the save is refused. It holds a
    row for each document, with its terms and their counts, so a batch of queries is one scan.
    """

    TOKENIZER = "lower;[\\p{L}\\p{N}]+;1"

    def __init__(self, spark, path: str, version: str, tokenizer: Tokenizer = tokens, tokenizer_version: str = TOKENIZER):
        self.spark, self.tokenizer = spark, tokenizer
        self.fingerprint = hashlib.sha256(f"{version}\n{tokenizer_version}".encode()).hexdigest()[:16]
        self.path = f"{path}/{self.fingerprint}"
        self.log = CommitLog(spark, f"{self.path}/log")

    def _folder(self) -> str | None:
        return self.log.read(self.log.latest()).get("folder")

    def exists(self) -> bool:
        return self._folder() is not None

    def clear(self) -> int:
        """A new generation without an index; builds that are under way are refused."""
        while True:
            number = self.log.latest() + 1
            if self.log.commit(number, {"folder": None}):
                return number

    def build(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Build and save; another's index of the same generation serves as well."""
        generation = self.log.latest()
        if self.exists():
            return
        folder = uuid.uuid4().hex
        counted = counted_documents(docs, key, text, self.tokenizer)
        counted.write.parquet(f"{self.path}/{folder}/documents")
        discard([counted])
        if not self.log.commit(generation + 1, {"folder": folder}):
            path, files = self.log.fs(f"{self.path}/{folder}")
            files.delete(path, True)
            if not self.exists():
                raise StaleWrite(f"the index of generation {generation} was cleared while it was built")

    def topk(self, queries: DataFrame, k: int, **options) -> DataFrame:
        return score_postings(queries, self.spark.read.parquet(f"{self.path}/{self._folder()}/documents"), k, tokenizer=self.tokenizer, **options)


def ranked(scored: DataFrame, k: int, query: str = "query_id", ties: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2_048, shard: int = 16_384) -> DataFrame:
    """query_id, vec_id, score, rank by exact cosine; both sides are (id, embedding), ids of any type that orders.

    Queries are dealt to blocks of about `block` rows and vectors to shards of about `shard`;
    every block meets every shard in one task, which gives k rows for each of
    its queries. The plan is the same whatever their number, and nothing
    comes to the driver but two counts. Null, zero and non-finite vectors match nothing, nor do vectors of different sizes.
    """
    asked = queries.where("embedding is not null and query_id is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    known = vectors.where("embedding is not null and vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks, shards = max(1, -(-asked.count() // block)), max(1, -(-known.count() // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = asked.withColumn("block", deal("query_id", blocks)).withColumn("shard", every(shards))
    right = known.withColumn("shard", deal("vec_id", shards)).withColumn("block", every(blocks))

    kinds = ", ".join(f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((asked, "query_id"), (known, "vec_id")))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(nearest_rows(k), f"{kinds}, score double")
    return ranked(found, k, ties="vec_id")


def nearest_rows(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two tables, (query_id, embedding) and (vec_id, embedding): the k best of the second for each row of the first."""

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        ids, sought = _units(one, "query_id")
        names, given = _units(other, "vec_id")
        parts = []
        for size in sought.keys() & given.keys():
            (rows, unit), (places, matrix) = sought[size], given[size]
            for start in range(0, len(rows), 256):
                cos = np.round(unit[start : start + 256] @ matrix.T, PLACES)
                least = np.partition(cos, -k, axis=1)[:, -k, None] if cos.shape[1] > k else -np.inf
                row, column = np.nonzero(cos >= least)
                best = _first(row, cos[row, column], column, k)  # vectors come by id, so ties fall to the least
                row, column = row[best], column[best]
                parts.append(pa.table([ids.take(pa.array(rows[start + row])), names.take(pa.array(places[column])), pa.array(cos[row, column])], ["query_id", "vec_id", "score"]))
        none = pa.table([ids.slice(0, 0), names.slice(0, 0), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        return pa.concat_tables(parts) if parts else none

    return score


def _units(rows: pa.Table, key: str) -> tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids in order, and by size of vector the places in them of usable vectors and those at unit length."""
    rows = rows.select([key, "embedding"]).sort_by(key).combine_chunks()
    ids, lists = rows.column(key).combine_chunks(), rows.column("embedding").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is not a number
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == size)
        matrix = values.reshape(-1, size) if len(places) == len(sizes) else values[starts[places][:, None] + np.arange(size)]
        length = np.linalg.norm(matrix, axis=1)
        good = np.isfinite(length) & (length > 0)
        if good.any():
            out[size] = places[good], matrix[good] / length[good, None]
    return ids, out


def fusion_key(chunk_id: Column, document_id: Column, content: Column) -> Column:
    """chunk id, else document id, else the content's digest."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.nullif(document_id, F.lit("")), F.sha2(content, 256))


def reciprocal_rank_fusion(lists: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """(query_id, list_no, rank from 1, key) -> query_id, key, score, rank.

    Ties keep the order of first appearance: by list, then rank. A key that is
    missing from a list, or a list that failed and is empty, adds nothing.
    """
    summed = lists.groupBy("query_id", "key").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("raw"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    summed = summed.withColumn("score", F.round("raw", PLACES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list_no", "first.rank", "key")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "key", "score", "rank")


def post_filter(fused: DataFrame, condition: Column) -> DataFrame:
    """A filter above the cut: rows beyond the limit never move up."""
    return fused.where(condition)


def rerank(candidates: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], top_n: int, threshold: float = 0.1, cap: int = 12) -> DataFrame:
    """(query_id, rank, query, content, ...) -> the best of the first `cap` that score above `threshold`, strictly.

    `score` is a pandas function of queries and contents; Arrow's batch size is
    its micro-batch. Ties keep the earlier rank. Where it raises for a batch,
    or gives no number, the rows score 0, and a query without any score gets its first `top_n`.
    """

    def safe(queries: pd.Series, contents: pd.Series) -> pd.Series:
        try:
            return pd.to_numeric(pd.Series(score(queries, contents)), errors="coerce").astype(float)
        except Exception:  # a model that fails costs its scores, not the search
            return pd.Series([None] * len(queries), dtype=float)

    safe.__annotations__ = {"queries": pd.Series, "contents": pd.Series, "return": pd.Series}
    scorer = F.pandas_udf(safe, "double")
    scored = candidates.where(F.col("rank") <= cap).withColumn("_raw", F.nanvl(scorer("query", "content"), F.lit(None).cast("double")))
    own = Window.partitionBy("query_id")
    scored = scored.withColumn("_failed", F.count("_raw").over(own) == 0).withColumn("score", F.coalesce("_raw", F.lit(0.0)))
    kept = scored.withColumn("position", F.row_number().over(own.orderBy(F.desc("score"), "rank")))
    return kept.where((F.col("_failed") | (F.col("score") > threshold)) & (F.col("position") <= top_n)).drop("_raw", "_failed")


def project(ranked_rows: DataFrame, limit: int, content_limit: int = 800) -> DataFrame:
    """query_id, rank, chunk_id, source_file, content cut to the limit; blank contents are left out."""
    content = strip(F.col("content"))
    return ranked_rows.where((F.col("rank") <= limit) & (F.length(content) > 0)).select(
        "query_id", "rank", "chunk_id", "source_file", trim_after(content, content_limit).alias("content")
    )


def paginate(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with total and has_more; a limit of 1 and an offset of 0 at least."""
    limit, offset = max(1, limit), max(0, offset)
    total = rows.agg(F.count("*").alias("total"))  # one row
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def requests(rows: DataFrame, most: int = 2_000) -> DataFrame:
    """(query, top_k, mode) trimmed, top_k in 1..10, the mode one of hybrid, bm25 and vector; empty and overlong queries are left out."""
    query, mode = strip(F.col("query")), F.lower(strip(F.coalesce("mode", F.lit("hybrid"))))
    kept = rows.where(F.length(query).between(1, most) & mode.isin("hybrid", "bm25", "vector"))
    return kept.withColumns({"query": query, "top_k": F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("top_k", F.lit(5)))), "mode": mode})


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, unit length; null without words."""
    places = F.transform(tokens(F.lower(text)), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("p"), F.when(F.pmod(F.xxhash64(w, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(places, lambda x: x["p"] == i), F.lit(0.0), lambda acc, x: acc + x["s"]))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when(norm > 0, F.transform(sums, lambda v: (v / norm).cast("float")))
