"""Running sums in two levels, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import written


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`rows` with sums of whole or floating values over all rows up to and with their own, within `keys` and by `order`.

    Rows are dealt by ranges of keys and order and written once, so a key with
    any share of them lies in many parts. Only the first key of a part can go
    on from earlier ones: what those add is a row a part at most. `order` is to
    be unique within its keys; null keys are a key, null values add nothing.
    """
    for name, value in sums.items():
        rows = rows.withColumn(name, F.coalesce(value, F.lit(0)))
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys, "_part").agg(*(F.sum(name).alias(name) for name in sums))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.sum(name).over(earlier).alias(f"_{name}") for name in sums))
    before = before.where(F.greatest(*(F.col(f"_{name}") for name in sums), F.lit(None)).isNotNull())
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = dealt.join(F.broadcast(before), same, "left").drop("_p", *(f"_k{i}" for i in range(len(keys))))  # a row a part at most
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        met = met.withColumn(name, F.sum(name).over(here) + F.coalesce(F.col(f"_{name}"), F.lit(0))).drop(f"_{name}")
    return met.drop("_part")
