"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; whole texts are costly rows, so documents in fewer partitions than the session has cores are dealt out anew."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees.

    Only a local session may go without it; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tamarack-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.__dict__["_written"] = path
    return written


def drop_tables(spark: SparkSession, frames: list[DataFrame]) -> None:
    """Delete tables written by :func:`materialize` that nothing reads any more."""
    for frame in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.__dict__.pop("_written"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, modulus: int, remainder: int) -> DataFrame:
    """doc_id, text and `column` of labelled documents that are not held out, at most `rows`, in hash order.

    The bounded list of ids is all that is sent to the texts. Null ids, labels
    and texts give nothing; of two labels for one id the lower holds, and of several texts the least.
    """
    known = labels.where((F.col(column).isin(0, 1)) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.min(column).cast("int").alias(column))
    chosen = known.orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id").limit(rows)
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", column).agg(F.min("text").alias("text"))
    found = found.select("doc_id", "text", column)
    # Bounded by `rows`; what is fitted reads it more than once.
    return materialize(found, "labelled")
