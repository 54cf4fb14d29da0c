"""Connected components by alternating large-star and small-star passes.

Every pass is a join on a grouped minimum, so a hub's edges are split by the
adaptive skew join and its minimum is pre-aggregated; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import drop_tables, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(moved)


def _signature(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark % 1_000_003)).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of any one orderable type -> (node, root), root the least node.

    Self links and nulls are ignored, repeats are harmless, an empty table gives
    an empty table. Nodes without links don't appear. Each round is written to the shared folder.
    """
    edges = edges.where("a <> b").distinct()
    edges = materialize(edges, "edges")
    seen = None
    for _ in range(rounds):
        step = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = _signature(step)
        drop_tables(edges.sparkSession, [edges])
        edges = step
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
