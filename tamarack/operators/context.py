"""What a model is shown of tool results and history: payloads, excerpts within a size, compaction, session totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import fitting_prefix, token_estimate
from tamarack.operators.conversation import turns

# Share of the history limit that starts a compaction, turns that stay, least savings in tokens and as a share.
TRIGGER, RECENT, LEAST_SAVED, LEAST_SHARE = 0.8, 3, 128, 0.1
#: Characters of an envelope at least.
ENVELOPE = 256


def sourced(content: Column, source_file: Column, page: Column) -> Column:
    """A result's text under its source, with the page where it is 1 or more. The words are fixed values."""
    place = F.when(page >= 1, F.concat(F.lit("  第 "), page.cast("string"), F.lit(" 页"))).otherwise("")
    return F.concat(F.lit("[来源："), F.coalesce(source_file, F.lit("")), place, F.lit("]\n"), content)


def response(results: DataFrame, trace: DataFrame, include_meta: bool = True) -> DataFrame:
    """query_id, data and meta as JSON: a query's results in order, and what its search went through; fields without a value are left out."""
    item = F.struct("rank", "chunk_id", "source_file", "content")
    data = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    met = trace.join(data, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast("array<struct<rank:int,chunk_id:string,source_file:string,content:string>>")))
    names = ["stage", "returned", "candidates", "reranked", "top_score", "cache_hit"] if include_meta else ["stage"]
    data = F.to_json(F.struct((F.size("results") > 0).alias("has_relevant_content"), "results"))
    return met.select("query_id", data.alias("data"), F.to_json(F.struct(*names)).alias("meta"))


def envelope(rows: DataFrame, limit: int, key: str = "call_id") -> DataFrame:
    """(key, tool, query, ok, data) -> key, content: the JSON of a result, its data cut to a preview where it is over the limit.

    Anything left out is marked, and the whole stays within the limit (ENVELOPE at least).
    """
    limit = max(limit, ENVELOPE)
    whole = F.to_json(F.struct("ok", "tool", "query", "data"))
    made = lambda preview: F.to_json(
        F.struct(
            "ok", "tool", F.left(F.coalesce("query", F.lit("")), F.lit(120)).alias("query"), F.struct(preview.alias("preview"), F.lit(True).alias("context_truncated")).alias("data"),
            F.struct(F.lit(True).alias("context_truncated"), F.length(whole).alias("original_chars")).alias("meta"),
        )
    )
    room = F.lit(limit) - F.length(made(F.lit("")))
    return rows.select(key, F.when(F.length(whole) <= limit, whole).otherwise(made(fitting_prefix(F.coalesce("data", F.lit("")), room))).alias("content"))


def excerpts(items: DataFrame, limit: int, key: str = "call_id") -> DataFrame:
    """(key, position, chunk_id, content) -> with excerpt and truncated: a third of each text's even share, while the running JSON fits.

    A call whose first item doesn't fit has one row without excerpt, marked EVIDENCE_PAYLOAD_TOO_LARGE (a fixed value).
    """
    n = F.count("*").over(Window.partitionBy(key))
    share = F.floor(F.floor(F.lit(limit) / n) / 3).cast("int")
    rows = items.withColumn("excerpt", F.left(F.coalesce("content", F.lit("")), share))
    rows = rows.withColumn("_size", F.sum(F.length(F.to_json(F.struct("chunk_id", F.col("excerpt").alias("content"))))).over(Window.partitionBy(key).orderBy("position")))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy("position")) == 1)
    over = F.col("_size") > limit
    kept = rows.where(~over | F.col("_first")).withColumn("error", F.when(over, "EVIDENCE_PAYLOAD_TOO_LARGE"))
    kept = kept.withColumn("excerpt", F.when(F.col("error").isNull(), F.col("excerpt")))
    return kept.withColumn("truncated", F.col("error").isNull() & (F.length("excerpt") < F.length(F.coalesce("content", F.lit(""))))).drop("_size", "_first")


def compaction_turns(turns: DataFrame, history_limit: int, source_limit: int) -> DataFrame:
    """(thread_id, turn, tokens) of completed turns -> those to summarise: the earliest, RECENT left out, while their sum fits.

    A thread whose tokens are under TRIGGER of the history limit, or that has no more than RECENT turns, has none.
    """
    own = Window.partitionBy("thread_id")
    rows = turns.withColumns({
        "_all": F.sum("tokens").over(own), "_left": F.row_number().over(own.orderBy(F.desc("turn"))),
        "source_tokens": F.sum("tokens").over(own.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)),
    })
    return rows.where((F.col("_all") >= int(history_limit * TRIGGER)) & (F.col("_left") > RECENT) & (F.col("source_tokens") <= source_limit)).drop("_all", "_left")


# Characters that tool results are cut to in turn, and the outcomes of a budget.
TOOL_CHARS = (2_048, 1_024, 512, 256, 0)
FITS, FIXED_OVER, USER_OVER, TURN_OVER = "within_budget", "FIXED_CONTEXT_TOO_LARGE", "USER_INPUT_TOO_LARGE", "CURRENT_TURN_CONTEXT_TOO_LARGE"
#: Halvings of the evidence limit; 2 ** 20 records are gone after them.
HALVINGS = 20


#: What goes into a request beside its messages; the evidence of the current turn lies within its messages.
PARTS = ("system_tokens", "directive_tokens", "tool_schema_tokens", "summary_tokens", "historical_evidence_tokens")
# Why a request was cut, by what was taken from it.
CUTS = {"tool_content_chars_removed": "tool_payload_budget", "evidence_excerpt_chars_removed": "evidence_excerpt_budget", "evidence_records_omitted": "evidence_record_budget"}


def budget_report(messages: DataFrame, requests: DataFrame, overhead: int = 4) -> DataFrame:
    """The sums of each thread's request: its parts, the history, the current user message, the rest of the current turn, and all.

    messages (thread_id, idx, type, content); requests (thread_id, limit, the columns of
    PARTS, evidence_tokens, and of CUTS). evidence_tokens of the result are those of the
    current turn and of history. A request without messages has zeros; nulls count as 0.
    """
    rows = turns(messages.withColumn("content", F.coalesce("content", F.lit("")))).withColumn("_t", token_estimate(F.col("content")) + overhead)
    by_turn = rows.groupBy("thread_id", "turn").agg(F.sum("_t").alias("_t"), F.min_by("_t", "idx").alias("_first"))
    last = F.struct("_t", "_first")
    sums = by_turn.groupBy("thread_id").agg(F.sum("_t").alias("_all"), F.max_by(last, "turn").alias("_last"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    given = requests.select("thread_id", *map(zero, ("limit", *PARTS, "evidence_tokens", *CUTS)))
    history, user = F.coalesce(F.col("_all") - F.col("_last._t"), F.lit(0)), F.coalesce("_last._first", F.lit(0))
    other = F.coalesce(F.col("_last._t") - F.col("_last._first"), F.lit(0))
    total = sum((F.col(c) for c in PARTS), F.coalesce("_all", F.lit(0)))
    reasons = F.filter(F.array(*(F.when(F.col(c) > 0, reason) for c, reason in CUTS.items())), F.isnotnull)
    return given.join(sums, "thread_id", "left").select(
        "thread_id", F.col("limit").alias("input_limit_tokens"), total.alias("estimated_input_tokens"), *PARTS, user.alias("current_user_tokens"), other.alias("current_turn_other_tokens"),
        (F.col("evidence_tokens") + F.col("historical_evidence_tokens")).alias("evidence_tokens"), history.alias("recent_history_tokens"), (total <= F.col("limit")).alias("within"), reasons.alias("projection_reasons"),
    )


def fit_budget(messages: DataFrame, budgets: DataFrame, overhead: int = 4) -> DataFrame:
    """The mildest way to bring each thread's next request within its limit, and what the request then holds.

    messages (thread_id, idx, type, content); budgets (thread_id, limit, system_tokens,
    schema_tokens, summary_tokens, n_records, record_tokens). The last turn is the current one. What may give
    way, in this order: tool results of completed turns are cut to TOOL_CHARS in turn, then the oldest turn
    goes and the next are cut; with no completed turn left the summary goes; the evidence records are
    halved down to none; tool results of the current turn are cut. All levels are worked out for all
    threads at once from sums by turn, and the least that fits is taken: no loop over requests.
    A thread without messages has no row; negative or null sizes count as 0.
    """
    caps = [None, *TOOL_CHARS]
    size = lambda cap: token_estimate(F.when(F.col("type") == "tool", F.left("content", F.lit(cap))).otherwise(F.col("content")) if cap is not None else F.col("content")) + overhead
    rows = turns(messages.withColumn("content", F.coalesce("content", F.lit(""))))
    by_turn = rows.groupBy("thread_id", "turn").agg(*(F.sum(size(c)).cast("long").alias(f"c{k}") for k, c in enumerate(caps)), F.sum(F.when(F.col("type") == "human", size(None)).otherwise(0)).cast("long").alias("user_tokens"))
    own = Window.partitionBy("thread_id")
    newest_first = own.orderBy(F.desc("turn"))
    placed = by_turn.withColumns({"back": F.row_number().over(newest_first), "turns": F.count("*").over(own)})
    # Tokens of the completed turns from this one on.
    kept = placed.withColumns({f"s{k}": F.sum(F.when(F.col("back") > 1, F.col(f"c{k}")).otherwise(0)).over(newest_first.rowsBetween(Window.unboundedPreceding, 0)) for k in range(len(caps))})
    zero = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c)
    given = budgets.select("thread_id", *map(zero, ("limit", "system_tokens", "schema_tokens", "summary_tokens", "n_records", "record_tokens")))
    current = kept.where("back = 1").select("thread_id", F.col("turns").alias("_turns"), "user_tokens", *(F.col(f"c{k}").alias(f"current{k}") for k in range(len(caps)))).join(given, "thread_id")
    n = len(caps)
    whole = F.col("summary_tokens") + F.col("n_records") * F.col("record_tokens")
    level = lambda number, dropped, chars, summary, records, now, completed, mine: F.struct(
        number.cast("long").alias("level"), dropped.cast("long").alias("dropped_turns"), chars.cast("int").alias("tool_chars"), summary.alias("summary_kept"), records.cast("long").alias("records_kept"),
        now.cast("int").alias("current_tool_chars"), completed.cast("long").alias("completed_tokens"), mine.cast("long").alias("current_tokens"),
    )
    none = F.lit(None)
    with_turns = kept.where("back > 1").join(current.drop("user_tokens"), "thread_id")
    dropped = F.col("turns") - F.col("back")
    early = F.array(*(level(dropped * n + k, dropped, none if c is None else F.lit(c), F.lit(True), F.col("n_records"), none, F.col(f"s{k}"), F.col("current0")) for k, c in enumerate(caps)))
    gone = F.col("_turns") - 1
    late = [level(gone * n, gone, none, F.lit(True), F.col("n_records"), none, F.lit(0), F.col("current0"))]
    late += [level(gone * n + 1 + i, gone, none, F.lit(False), F.shiftright("n_records", i), none, F.lit(0), F.col("current0")) for i in range(HALVINGS + 1)]
    late += [level(gone * n + 2 + HALVINGS + k, gone, none, F.lit(False), F.lit(0), F.lit(c), F.lit(0), F.col(f"current{k + 1}")) for k, c in enumerate(TOOL_CHARS)]
    names = ["thread_id", "limit", "system_tokens", "schema_tokens", "summary_tokens", "record_tokens"]
    levels = with_turns.select(*names, F.explode(early).alias("l")).unionByName(current.select(*names, F.explode(F.array(*late)).alias("l"))).select(*names, "l.*")
    evidence = F.col("records_kept") * F.col("record_tokens")
    levels = levels.withColumns({"evidence_tokens": evidence, "summary_tokens": F.when(F.col("summary_kept"), F.col("summary_tokens")).otherwise(0)})
    levels = levels.withColumn("total_tokens", F.col("system_tokens") + F.col("schema_tokens") + F.col("summary_tokens") + F.col("evidence_tokens") + F.col("completed_tokens") + F.col("current_tokens"))
    fields = ["dropped_turns", "tool_chars", "summary_kept", "records_kept", "current_tool_chars", "summary_tokens", "evidence_tokens", "completed_tokens", "current_tokens", "total_tokens"]
    best = levels.where(F.col("total_tokens") <= F.col("limit")).groupBy("thread_id").agg(F.min_by(F.struct(*fields), "level").alias("b"))
    fixed = F.col("system_tokens") + F.col("schema_tokens")
    outcome = F.when(fixed > F.col("limit"), FIXED_OVER).when(fixed + F.col("user_tokens") > F.col("limit"), USER_OVER).when(F.col("b").isNull(), TURN_OVER).otherwise(FITS)
    out = current.select("thread_id", "limit", "system_tokens", "schema_tokens", "user_tokens").join(best, "thread_id", "left").withColumn("outcome", outcome)
    return out.select("thread_id", "outcome", "system_tokens", "schema_tokens", "user_tokens", *(F.when(F.col("outcome") == FITS, F.col(f"b.{f}")).alias(f) for f in fields))


def required_savings(source_tokens: Column) -> Column:
    return F.greatest(F.lit(LEAST_SAVED), F.floor(source_tokens * LEAST_SHARE).cast("int"))


def worth_compacting(source_tokens: Column, floor_tokens: Column) -> Column:
    return source_tokens - floor_tokens >= required_savings(source_tokens)


def retry_after(source_tokens: Column, status: Column, new_tokens: Column) -> Column:
    """Source tokens from which a thread may be tried again: at once after success, else after some new ones."""
    return F.when(status == "accepted", source_tokens).otherwise(source_tokens + F.greatest(F.lit(1), new_tokens))


def due(attempts: DataFrame) -> DataFrame:
    """(thread_id, at, source_tokens, status, new_tokens): whether each attempt was due, given the one before it."""
    order = Window.partitionBy("thread_id").orderBy("at")
    before = F.lag(F.when(F.col("status").isin("deferred", "rejected"), retry_after(F.col("source_tokens"), F.col("status"), F.col("new_tokens")))).over(order)
    return attempts.withColumn("due", F.coalesce(F.col("source_tokens") >= before, F.lit(True)))


def fingerprint(messages: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """SHA-256 over the messages' JSON lines in order, one for each key."""
    line = F.to_json(F.struct(*columns))
    grouped = messages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("m"))
    return grouped.select(*keys, F.sha2(F.array_join(F.transform("m", lambda x: x["line"]), "\n"), 256).alias("fingerprint"))


def session_totals(turns: DataFrame, limit: float) -> DataFrame:
    """(session_id, cost, unpriced, tokens, calls, tool_runs) a turn -> totals a session and whether they reach the limit."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    summed = turns.groupBy("session_id").agg(F.count("*").alias("turns"), total("cost"), total("unpriced"), total("tokens"), total("calls"), total("tool_runs"))
    return summed.withColumn("over_budget", F.col("cost") >= limit)


def tools_with(tools: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(tool, capabilities array) and (capability) -> capability, tools: the tools that have it, sorted; none is an empty list."""
    held = tools.select("tool", F.explode("capabilities").alias("capability")).distinct()
    met = capabilities.select("capability").distinct().join(held, "capability", "left")
    return met.groupBy("capability").agg(F.array_sort(F.collect_list("tool")).alias("tools"))


def snapshots(stages: DataFrame) -> DataFrame:
    """(case_id, stage, position, chunk_id, source_file, source_page, content) -> the same with rank from 1 and content_chars instead of the text."""
    order = Window.partitionBy("case_id", "stage").orderBy("position", "chunk_id")
    return stages.withColumn("rank", F.row_number().over(order)).withColumn("content_chars", F.length(F.coalesce("content", F.lit("")))).drop("content", "position")


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values, order and repeats aside; a null list is an empty one."""
    empty = F.array().cast("array<string>")
    plain = lambda c: F.array_sort(F.array_distinct(F.coalesce(c.cast("array<string>"), empty)))
    return plain(a) == plain(b)
