"""Ingestion metrics of streams: a listener that appends each batch's rates to a log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch bigint, at string, rows bigint, seconds double, rows_per_second double, state_rows bigint"


class MetricsLog(StreamingQueryListener):
    """One JSON file for each batch that read rows, under a shared folder; read them with :func:`metrics`.

    Files, not rows of one file: whichever driver runs the stream adds its own, and none waits for another.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows, seconds = progress.numInputRows, (progress.batchDuration or 0) / 1000
        if not rows:
            return
        row = {
            "query": progress.name or str(progress.id), "batch": progress.batchId, "at": progress.timestamp, "rows": rows, "seconds": seconds,
            "rows_per_second": round(rows / seconds, 2) if seconds else 0.0, "state_rows": sum(s.numRowsTotal for s in progress.stateOperators),
        }
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        stream.write(bytearray(json.dumps(row).encode()))
        stream.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
