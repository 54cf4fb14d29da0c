"""Usage accounting: token normalisation, tariffs, cost, deltas, rate windows, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import strip


def normalise_usage(hit: Column, miss: Column, prompt: Column, completion: Column) -> Column:
    """Provider counts where given; else misses are the prompt without the hits, never under 0."""
    hits = F.coalesce(hit, F.lit(0))
    misses = F.coalesce(miss, F.greatest(F.lit(0), F.coalesce(prompt, F.lit(0)) - hits))
    return F.struct(hits.alias("cache_hit_tokens"), misses.alias("cache_miss_tokens"), F.coalesce(completion, F.lit(0)).alias("completion_tokens"))


def normalise_model(name: Column, prefixes: tuple[str, ...] = ()) -> Column:
    plain = F.lower(strip(name))
    return F.regexp_replace(plain, "^(" + "|".join(prefixes) + ")/", "") if prefixes else plain


def tariff(called_at: Column, zone: str, weekdays: list[int], ranges: list[tuple[int, int]]) -> Column:
    """peak inside a half-open range of minutes on a listed ISO weekday, in the card's zone; times are UTC."""
    local = F.from_utc_timestamp(called_at.cast("timestamp"), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | ((minute >= start) & (minute < end))
    return F.when((F.weekday(local) + 1).isin(weekdays) & inside, "peak").otherwise("off_peak")


def cost(usage: DataFrame, aliases: DataFrame, rates: DataFrame, zone: str, weekdays: list[int], ranges: list[tuple[int, int]], unit: int = 1_000_000, windows: dict | None = None) -> DataFrame:
    """usage with canonical, tariff, status and amount.

    usage: model, called_at, cache_hit_tokens, cache_miss_tokens, completion_tokens, and what else it has.
    aliases: alias, canonical. rates: canonical, tariff, effective_from, hit_rate, miss_rate, output_rate.
    The card that was in force at the call holds (as-of); no model or none in force is unpriced, a negative count invalid.
    `windows` gives a canonical model weekdays and ranges of its own.
    """
    named = usage.withColumn("_alias", normalise_model(F.col("model"))).join(aliases.withColumnRenamed("alias", "_alias"), "_alias", "left")
    at = tariff(F.col("called_at"), zone, weekdays, ranges)
    for model, own in (windows or {}).items():
        at = F.when(F.col("canonical") == model, tariff(F.col("called_at"), zone, *own)).otherwise(at)
    named = named.withColumn("tariff", at)
    # One card interval per version: a call meets one at most.
    versions = Window.partitionBy("canonical", "tariff").orderBy("effective_from")
    cards = rates.withColumn("_until", F.lead("effective_from").over(versions))
    cards = cards.withColumnsRenamed({"canonical": "_canonical", "tariff": "_tariff"})
    fits = (
        (F.col("canonical") == F.col("_canonical")) & (F.col("tariff") == F.col("_tariff"))
        & (F.col("called_at") >= F.col("effective_from")) & (F.col("_until").isNull() | (F.col("called_at") < F.col("_until")))
    )
    met = named.join(cards, fits, "left")
    negative = (F.col("cache_hit_tokens") < 0) | (F.col("cache_miss_tokens") < 0) | (F.col("completion_tokens") < 0)
    status = F.when(F.col("_canonical").isNull(), "unpriced").when(negative, "invalid_usage").otherwise("priced")
    # A decimal sum, divided as a double: decimal division would round to six places.
    sums = F.col("cache_hit_tokens") * F.col("hit_rate") + F.col("cache_miss_tokens") * F.col("miss_rate") + F.col("completion_tokens") * F.col("output_rate")
    amount = sums.cast("double") / unit
    return met.withColumn("status", status).withColumn("amount", F.when(F.col("status") == "priced", amount)).drop(
        "_alias", "_canonical", "_tariff", "_until", "effective_from", "hit_rate", "miss_rate", "output_rate"
    )


def turn_deltas(counters: DataFrame, key: str, order: str, columns: list[str], floored: tuple[str, ...] = ()) -> DataFrame:
    """Per-turn differences of cumulative counters; a missing previous count is 0, floored ones never go under 0."""
    turns = Window.partitionBy(key).orderBy(order)
    delta = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.lag(c).over(turns), F.lit(0))
    return counters.select(key, order, *((F.greatest(F.lit(0), delta(c)) if c in floored else delta(c)).alias(f"{c}_delta") for c in columns))


def rate_limited(requests: DataFrame, limit: int, key: str = "bucket", at: str = "ts", ties: str = "request_id") -> DataFrame:
    """Fixed one-minute windows: requests after the limit-th of their key and minute are rejected."""
    minute = F.date_trunc("minute", F.col(at))
    order = Window.partitionBy(key, "minute").orderBy(at, ties)
    rows = requests.withColumn("minute", minute).withColumn("position", F.row_number().over(order))
    return rows.withColumn("rejected", F.col("position") > limit)


def daily_budget(requests: DataFrame, budget: float, tokens: str, key: str = "bucket", at: str = "ts", ties: str = "request_id") -> DataFrame:
    """A request is refused when what the day used before it has reached the budget; its tokens count all the same."""
    day = F.to_date(at)
    before = Window.partitionBy(key, "day").orderBy(at, ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("day", day).withColumn("used_before", F.coalesce(F.sum(tokens).over(before), F.lit(0)))
    return rows.withColumn("refused", F.col("used_before") >= budget)


def model_totals(priced: DataFrame) -> DataFrame:
    return priced.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.sum("cache_hit_tokens").alias("hit_tokens"),
        F.sum("cache_miss_tokens").alias("miss_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("amount"), 6).alias("amount"),
        F.count_if(F.col("status") != "priced").alias("unpriced"),
    )


def histogram(rows: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Cumulative counts at fixed upper bounds, the last one infinite: bound_no, n_le."""
    counted = rows.groupBy(*(keys or [])).agg(
        *(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)), F.count(value).alias(f"_{len(bounds)}")
    )
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("bound_no"), F.col(f"_{i}").alias("n_le")) for i in range(len(bounds) + 1))))
    return counted.select(*(keys or []), cells.alias("c")).select(*(keys or []), "c.bound_no", "c.n_le")


def termination(rag_calls: Column, wants_retrieval: Column, wants_tools: Column, rounds: Column, batches: Column, limits: dict[str, int]) -> Column:
    """Why a run must close before its next tool batch, by priority; null if it may go on."""
    return F.when(
        wants_tools,
        F.when((rag_calls >= limits["rag_calls"]) & wants_retrieval, "rag_call_budget_exhausted")
        .when(rounds >= limits["rounds"], "model_round_budget_exhausted")
        .when(batches >= limits["batches"], "tool_batch_budget_exhausted"),
    )


def input_limit(policy: Column, window: Column, reserved: Column, margin: Column) -> Column:
    return F.least(policy, window - reserved - margin)


def recursion_minimum(rounds: Column, batches: Column) -> Column:
    return 1 + rounds + 3 * batches + 2 + 4
