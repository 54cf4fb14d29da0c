"""Usage of model calls: several responses as one, a thread's running counters, a request's event log; and the price catalogue."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import strip
from tamarack.operators.metering import cost, normalise_model
from tamarack.operators.running import running_sums

COUNTS = ("cache_hit_tokens", "cache_miss_tokens", "completion_tokens", "reasoning_tokens", "prompt_tokens", "total_tokens")
#: A catalogue is a small file that the driver reads.
CATALOGUE_BYTES = 1 << 20


def combined(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each answer that took several responses: the sums of COUNTS (null counts as 0) and aggregated_model_calls."""
    return responses.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), F.count("*").alias("aggregated_model_calls"))


def running_usage(calls: DataFrame, key: str, order: str) -> DataFrame:
    """Calls with their thread's counters after them: all_ and each of COUNTS, estimated_cost, unpriced_model_count, llm_call_count.

    calls: key, order (unique in the key), COUNTS, amount, status as in :func:`metering.cost`. An
    amount that is null adds nothing and its call is unpriced. Costs are added as decimals of twelve places. The counters are added in two levels, so a thread may be of any size.
    """
    sums = {f"all_{c}": F.col(c) for c in COUNTS}
    sums |= {"estimated_cost": F.col("amount").cast("decimal(24,12)"), "unpriced_model_count": (~F.col("status").eqNullSafe("priced")).cast("long"), "llm_call_count": F.lit(1).cast("long")}
    rows = running_sums(calls, [key], [order], sums)
    return rows.withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


# Names of events and of the frames they become; marks of calls whose text a reader doesn't see.
HIDDEN_TAG, HIDDEN_NODE, HIDDEN_KIND, META_CHARS = "context_compaction", "compact_history", "finalizer", 300


def _succeeded(output: Column) -> Column:
    """The ok of a JSON object, as a truth value; true where it has none or the output is no object."""
    value = F.to_json(F.try_variant_get(F.try_parse_json(output), "$.ok", "variant"))
    return ~F.coalesce(value.isin("false", "null", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _framed(events: DataFrame) -> DataFrame:
    """events with frame, null for those that give none."""
    hidden = F.array_contains("tags", HIDDEN_TAG) | (F.col("node") == HIDDEN_NODE) | (F.col("kind") == HIDDEN_KIND)
    content = F.coalesce("content", F.lit(""))
    answer = F.col("is_root") & (F.length(strip(content)) > 0) & (F.coalesce("n_tool_calls", F.lit(0)) == 0)
    frame = (
        F.when((F.col("event") == "on_chat_model_stream") & (content != "") & ~F.coalesce(hidden, F.lit(False)), "token")
        .when(F.col("event") == "on_tool_start", "tool_call").when(F.col("event") == "on_tool_end", "tool_result").when(F.col("event") == "on_chat_model_end", "usage")
        .when((F.col("event") == "on_chain_end") & F.coalesce(answer, F.lit(False)), "answer_commit")
    )
    return events.withColumn("frame", frame)


def frames(events: DataFrame) -> DataFrame:
    """An event log -> the frames that a reader gets: request_id, seq, at_ms, frame, payload (JSON); other events are left out.

    events: request_id, seq, at_ms, event, name, content, output, tags
    (array), node, kind, is_root, n_tool_calls, prompt_tokens, completion_tokens, total_tokens, model, amount, status.
    Text of summaries and of final rounds is not streamed: the final answer comes whole, with the end of the root.
    """
    name, frame = F.coalesce("name", F.lit("")), F.col("frame")
    amount = F.when(F.col("status") == "priced", F.col("amount"))
    payload = (
        F.when(frame == "token", F.to_json(F.struct(F.col("content").alias("delta"))))
        .when(frame == "tool_call", F.to_json(F.struct(name.alias("name"), F.col("content").alias("args"))))
        .when(frame == "tool_result", F.to_json(F.struct(name.alias("name"), _succeeded(F.col("output")).alias("ok"), F.left(F.coalesce("output", F.lit("")), F.lit(META_CHARS)).alias("meta"))))
        .when(frame == "usage", F.to_json(F.struct("prompt_tokens", "completion_tokens", amount.alias("cost"), F.col("status").alias("cost_status"))))
        .otherwise(F.to_json(F.struct("content")))
    )
    return _framed(events).where("frame is not null").select("request_id", "seq", "at_ms", "frame", payload.alias("payload"))


def request_usage(events: DataFrame) -> DataFrame:
    """Totals of each request: total_tokens, total_cost, unpriced_model_count, n_calls, ttft_ms.

    ttft_ms is when its answer was committed (the last, if several), else when its first
    token was shown, null if neither. The same aggregation runs over a table or, in update mode, a stream.
    """
    ended, priced = F.col("event") == "on_chat_model_end", F.col("status").eqNullSafe("priced")
    commit, first = (least(F.when(F.col("frame") == kind, F.col("at_ms"))) for least, kind in ((F.max, "answer_commit"), (F.min, "token")))
    return _framed(events).groupBy("request_id").agg(
        F.coalesce(F.sum(F.when(ended, F.col("total_tokens"))), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(ended & priced, F.col("amount"))), F.lit(0.0)).alias("total_cost"),
        F.count_if(ended & ~priced).alias("unpriced_model_count"), F.count_if(ended).alias("n_calls"), F.coalesce(commit, first).alias("ttft_ms"),
    )


def request_models(events: DataFrame) -> DataFrame:
    """Tokens and cost of each request and model; a cost that is not priced adds nothing."""
    amount = F.when(F.col("status") == "priced", F.col("amount"))
    return events.where("event = 'on_chat_model_end'").groupBy("request_id", "model").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")), F.coalesce(F.sum(amount), F.lit(0.0)).alias("cost")
    )


@dataclass
class Catalogue:
    """Prices as :func:`metering.cost` takes them; windows are each model's ISO weekdays and ranges of minutes."""

    version: str
    unit: int
    zone: str
    aliases: DataFrame
    rates: DataFrame
    windows: dict[str, tuple[list[int], list[tuple[int, int]]]] = field(default_factory=dict)


def _minute(text: str) -> int:
    hours, minutes = (int(part) for part in str(text).split(":")[:2])
    if not (0 <= hours < 24 and 0 <= minutes < 60):
        raise ValueError(f"no time of day: {text}")
    return hours * 60 + minutes


def load_catalogue(spark: SparkSession, path: str, parse: Callable[[str], dict] = json.loads, prefixes: tuple[str, ...] = ()) -> Catalogue:
    """A catalogue file, read by Spark and checked; what is wrong is a ValueError.

    rate_card_version, unit_tokens, timezone, models: {name: {aliases,
    effective_from, rates: {off_peak, peak: {cache_hit_input, cache_miss_input,
    output}}, peak_windows: {weekdays, ranges: [{start, end}]}}}. `parse` may be
    another format's loader. A name or alias stands for one model only.
    """
    rows = spark.read.format("binaryFile").load(path).where(f"length <= {CATALOGUE_BYTES}").select("content").take(2)
    if len(rows) != 1:
        raise ValueError(f"no single catalogue of {CATALOGUE_BYTES} bytes or less at {path}")
    given = parse(bytes(rows[0].content).decode()) or {}
    unit, zone, models = int(given.get("unit_tokens", 1_000_000)), given.get("timezone", "Asia/Shanghai"), given.get("models") or {}
    if unit <= 0 or not models:
        raise ValueError("a catalogue needs models and a positive unit_tokens")
    ZoneInfo(zone)
    names, cards, windows, owners = [], [], {}, {}
    for model, entry in models.items():
        for alias in (model, *entry.get("aliases", [])):
            names.append((alias, model))
        for tariff in ("off_peak", "peak"):
            rates = [str(entry["rates"][tariff][k]) for k in ("cache_hit_input", "cache_miss_input", "output")]
            if any(float(rate) < 0 for rate in rates):
                raise ValueError(f"a negative rate of {model}")
            cards.append((model, tariff, str(entry["effective_from"]), *rates))
        peak = entry.get("peak_windows") or {}
        days, ranges = sorted(set(peak.get("weekdays", []))), [(_minute(r["start"]), _minute(r["end"])) for r in peak.get("ranges", [])]
        if any(not 1 <= day <= 7 for day in days) or any(start >= end for start, end in ranges):
            raise ValueError(f"weekdays are 1 to 7 and ranges start before they end: {model}")
        windows[model] = (days, ranges)
    aliases = spark.createDataFrame(names, "alias string, canonical string").select(normalise_model(F.col("alias"), prefixes).alias("alias"), "canonical").distinct()
    for row in aliases.collect():  # a catalogue's names
        if owners.setdefault(row.alias, row.canonical) != row.canonical:
            raise ValueError(f"{row.alias} stands for {owners[row.alias]} and {row.canonical}")
    card = spark.createDataFrame(cards, "canonical string, tariff string, at string, h string, m string, o string")
    priced = card.select("canonical", "tariff", F.to_timestamp("at").alias("effective_from"), *(F.col(a).cast("decimal(18,6)").alias(b) for a, b in (("h", "hit_rate"), ("m", "miss_rate"), ("o", "output_rate"))))
    return Catalogue(str(given.get("rate_card_version", "")), unit, zone, aliases, priced, windows)


def price(calls: DataFrame, catalogue: Catalogue) -> DataFrame:
    """calls with their cost by a catalogue, each model's peak hours its own."""
    return cost(calls, catalogue.aliases, catalogue.rates, catalogue.zone, [], [], catalogue.unit, catalogue.windows).withColumn("rate_card_version", F.lit(catalogue.version))
