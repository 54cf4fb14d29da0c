"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of document changes becomes additive deltas (an insert adds, a delete
takes away, a revised count adds its difference), summed by key before they are
stored. A batch is one folder under its id, complete once it has Spark's success
mark; committing the same id again changes nothing, and a commit that died
half-way is written anew. Totals are the sum of all committed batches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The public vocabulary's own pre-tokenizer pattern, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
KEYS = ["source", "lang", "tokenizer"]
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        return _built(file.read())


def _built(vocabulary: bytes) -> tiktoken.Encoding:
    """Built once in each Python worker."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def count_tokens(rows: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, texts: dict[str, str] | None = None) -> DataFrame:
    """`keep` and the tokens of each whole text; null and empty texts have none.

    texts names the columns to count and the counts, {"text": "tokens"} by default; all
    are counted in one pass. The driver reads the vocabulary file and sends it
    out: its size is that of a vocabulary, whatever the table's.
    """
    texts = texts or {"text": "tokens"}
    with open(vocabulary, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _built(shared.value).encode_ordinary
        for batch in batches:
            counts = [pa.array([len(encode(t.as_py() or "")) for t in c], pa.int64()) for c in batch.columns[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts], [*keep, *texts.values()])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in texts.values())])
    return rows.select(*keep, *(F.col(c).alias(f"_text{k}") for k, c in enumerate(texts))).mapInArrow(scan, schema)


def inserts(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("d_docs"), F.col("tokens").alias("d_tokens"))


def deletes(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(-1).cast("long").alias("d_docs"), (-F.col("tokens")).alias("d_tokens"))


def revisions(counted: DataFrame, version: str) -> DataFrame:
    """(source, lang, old_tokens, tokens): the document stays, its count changes by the difference."""
    return counted.select(
        "source", "lang", F.lit(version).alias("tokenizer"), F.lit(0).cast("long").alias("d_docs"), (F.col("tokens") - F.col("old_tokens")).alias("d_tokens")
    )


class TokenRollup:
    """Totals under `path`, a folder that driver and executors share.

    Null sources and languages are keys like any other. A key whose documents
    and tokens are both zero has no row in the totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of complete batches."""
        path, files = self._at(self.path)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and files.exists(self._at(f"{self.path}/{n}/_SUCCESS")[0]))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Store a batch; False if this id is committed already. Deltas that cancel out leave no row."""
        if batch_id in self.committed():
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        summed.where("d_docs <> 0 or d_tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        paths = [f"{self.path}/batch={b}" for b in self.committed()]
        schema = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"
        stored = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        summed = stored.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")
