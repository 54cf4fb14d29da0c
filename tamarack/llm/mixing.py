"""Mix sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and read as one run of words,
cut into blocks of equal length. Golden-ratio points run through the cumulative
weights and give each slot of the schedule a source; a slot's rank within its
source names the block it takes, round after round. A document takes what its
share of those blocks takes.

Long running sums and ranks are made in two levels (within a range, then over
the ranges), so a source that holds a third of all rows is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import materialize

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block at most, and blocks that a source is cut into at least.
BLOCK_WORDS, LEAST_BLOCKS = 1_024, 1_024
#: Rows that a range of a two-level sum should have.
RANGE = 4_096
#: A slot in whole units, so that sums of slots don't depend on their order.
UNIT = 65_536


def _sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, number (by code point, null last), weight, part (its range in that order)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.select("*", F.shiftright("at", 33).alias("part")), "mix-sources")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    numbered = ordered.join(offsets, "part").select("source", "source_size", "part", number.alias("number"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    return materialize(numbered.withColumn("weight", weight), "mix-sources")


def _level(sources: DataFrame, cap: int) -> float | None:
    """Words for each unit of weight once no source is above `cap` times its size."""
    full = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while full:
        capped = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        held, open_weight = sources.agg(
            F.sum(F.when(capped, F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        raised = (full - cap * held) / open_weight
        if raised <= level:
            return level
        level = raised
    return None


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, size) -> one row per source: source, source_size, number, part, weight, target."""
    sources = _sources(rows, weights)
    level = _level(sources, cap)
    share = F.lit(level or 0.0) * F.col("weight")
    most = (F.col("source_size") * cap).cast("double")
    return sources.withColumn("target", F.when(share > most, most).otherwise(share))


def _schedule(plan: DataFrame, cap: int) -> DataFrame:
    """How often each block is taken: number, block, times."""
    part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    sums = plan.groupBy("part").agg(F.sum("slots").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    ends = plan.join(offsets, "part").withColumn("high", F.col("offset") + F.sum("slots").over(part))
    ends = ends.withColumn("low", F.col("high") - F.col("slots"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    count = -(-total // UNIT)
    # Slots and sources meet on cells of the scale.
    width = max(1, total // max(1, min(1 << 20, count // 256)))
    cell = lambda x: F.floor(x / F.lit(width))
    spread = ends.where("slots > 0").select("number", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    slot = F.col("id")
    fine = F.pmod(slot, F.lit(1 << 20)) * F.lit(GOLDEN)
    coarse = F.floor(slot / (1 << 20)) * F.lit((GOLDEN * (1 << 20)) % 1)
    point = (fine % 1 + coarse % 1) % 1
    slots = plan.sparkSession.range(count).select(slot, (point * F.lit(float(total))).alias("x")).withColumn("cell", cell(F.col("x")))
    placed = slots.join(spread, "cell").where("x >= low and x < high").select("id", "number", "blocks", F.floor(slot / RANGE).alias("chunk"))
    placed = materialize(placed, "mix-slots")
    sizes = placed.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("number", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("id")) - 1
    ranked = placed.withColumn("inner", inner).join(base, ["number", "chunk"]).withColumn("rank", F.col("base") + F.col("inner"))
    # A slot beyond a source's last permitted round takes nothing.
    taken = ranked.where(F.col("rank") < F.col("blocks") * cap)
    return taken.groupBy("number", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS, seed: str = "mix"
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    size counts words; null and empty texts have none and take nothing. Null
    sources are one source, ordered last. A block is taken at most `cap` times,
    so no document exceeds `cap` times its size. Equal rows may be taken
    differently, but as a set the rows of two runs agree. An empty table gives no rows.
    """
    counted = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(counted.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))), "mix-rows")
    plan = targets(rows, weights, cap)
    wanted = F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(least_blocks))
    width = F.when(F.col("source_size") > 0, F.ceil(F.col("source_size") / F.least(wanted, F.col("source_size"))))
    plan = plan.withColumn("width", width).withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")))
    plan = materialize(plan.withColumn("slots", F.coalesce(F.round(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT).cast("long"), F.lit(0))), "mix-plan")
    takes = _schedule(plan, cap)

    ranges = max(1, rows.count() // RANGE)
    spot = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / (1 << 32))
    facts = plan.select(F.col("source").alias("plan_source"), "number", "source_size", "target", "width")
    known = rows.join(facts, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("spot", spot)
    sums = known.groupBy("number", "spot").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("number").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("number", "spot", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("number", "spot").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    full = known.where("size > 0").withColumn("upto", F.sum("size").over(within)).join(bases, ["number", "spot"])
    full = full.withColumn("end", F.col("base") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    block = F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width"))))
    pieces = full.withColumn("block", block)
    words = F.least("end", (F.col("block") + 1) * F.col("width")) - F.greatest("start", F.col("block") * F.col("width"))
    keys = ["doc_id", "source", "size", "source_size", "target"]
    met = pieces.select(*keys, "number", "block", "start", words.alias("words")).join(takes, ["number", "block"], "left")
    taken = met.groupBy(*keys, "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = known.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.select(*keys, "taken").unionByName(empty)
