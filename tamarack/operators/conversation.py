"""Conversation analytics: turns, history budgets, merging, streaks, tool pairing, evidence ledgers.

Messages are (thread_id, idx, type in {human, ai, tool}, name, content, tool_call_id, ok, has_content).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import strip, token_estimate


def _thread():
    return Window.partitionBy("thread_id").orderBy("idx")


def turns(messages: DataFrame) -> DataFrame:
    """With turn: a new one where a human message follows none or a non-human; leading others are turn 1."""
    human = F.col("type") == "human"
    opens = (human & ~F.coalesce(F.lag(human).over(_thread()), F.lit(False))).cast("int")
    return messages.withColumn("turn", F.greatest(F.sum(opens).over(_thread()), F.lit(1)))


def completed(messages: DataFrame) -> DataFrame:
    """Without the current (last) turn."""
    last = Window.partitionBy("thread_id")
    return turns(messages).withColumn("_last", F.max("turn").over(last)).where("turn < _last").drop("_last")


def history_within(messages: DataFrame, budget: int, overhead: int = 4) -> DataFrame:
    """Newest whole turns while their tokens fit; the current turn is always kept, and an older one that doesn't fit ends the search.

    thread_id, turn, tokens, kept.
    """
    sizes = turns(messages).groupBy("thread_id", "turn").agg(F.sum(token_estimate(F.col("content")) + overhead).alias("tokens"))
    back = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    rows = sizes.withColumn("_sum", F.sum("tokens").over(back)).withColumn("_n", F.row_number().over(back))
    return rows.select("thread_id", "turn", "tokens", ((F.col("_n") == 1) | (F.col("_sum") <= budget)).alias("kept"))


def merge_humans(messages: DataFrame) -> DataFrame:
    """Runs of human messages become one, joined by a blank line: thread_id, idx (first), type, content, n."""
    other = (F.col("type") != "human") | ~F.coalesce(F.lag("type").over(_thread()) == "human", F.lit(False))
    rows = messages.withColumn("_run", F.sum(other.cast("int")).over(_thread()))
    parts = F.array_sort(F.collect_list(F.struct("idx", "content")))
    grouped = rows.groupBy("thread_id", "_run").agg(F.min("idx").alias("idx"), F.first("type").alias("type"), parts.alias("p"), F.count("*").alias("n"))
    return grouped.select("thread_id", "idx", "type", F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"), "n")


def page_runs(chunks: DataFrame, source: str = "source_file", key: str = "chunk_id", page: str = "page", text: str = "content") -> DataFrame:
    """Chunks in the text order of their ids, runs of equal pages joined by a blank line: source, run, page, text, n."""
    order = Window.partitionBy(source).orderBy(F.col(key).cast("string"))
    changed = (~F.lag(page).over(order).eqNullSafe(F.col(page)) | (F.row_number().over(order) == 1)).cast("int")
    rows = chunks.withColumn("run", F.sum(changed).over(order))
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))))
    grouped = rows.groupBy(source, "run").agg(F.first(page).alias("page"), parts.alias("p"), F.count("*").alias("n"))
    return grouped.select(source, "run", "page", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("page_text"), "n")


def miss_streak(calls: DataFrame) -> DataFrame:
    """Retrieval calls (thread_id, idx, ok, has_content) -> misses since the last hit; failed calls neither count nor break."""
    fine = calls.where("ok")
    last = fine.groupBy("thread_id").agg(F.max(F.when(F.col("has_content"), F.col("idx"))).alias("_hit"))
    rows = fine.join(last, "thread_id")
    return rows.groupBy("thread_id").agg(F.count_if(~F.col("has_content") & (F.col("idx") > F.coalesce("_hit", F.lit(-1)))).alias("misses"))


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    back = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def pair_tools(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (thread_id, call_id, tool) with results (thread_id, call_id, tool): one row per id and its state."""
    left = calls.groupBy("thread_id", "call_id").agg(F.min("tool").alias("called"), F.count("*").alias("n_calls"))
    right = results.groupBy("thread_id", "call_id").agg(F.min("tool").alias("answered"), F.count("*").alias("n_results"))
    met = left.join(right, ["thread_id", "call_id"], "full_outer")
    state = (
        F.when(F.col("n_calls").isNull(), "orphan")
        .when(F.col("n_results").isNull(), "missing")
        .when((F.col("n_results") > 1) | (F.col("n_calls") > 1), "duplicate")
        .when(~F.col("called").eqNullSafe(F.col("answered")), "mismatch")
        .otherwise("paired")
    )
    return met.select("thread_id", "call_id", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), state.alias("state"))


def display(messages: DataFrame) -> DataFrame:
    """Human texts and AI answers that call no tool; blanks dropped, roles renamed."""
    shown = messages.where((F.length(strip(F.coalesce("content", F.lit("")))) > 0) & F.col("type").isin("human", "ai"))
    if "n_tool_calls" in messages.columns:
        shown = shown.where((F.col("type") == "human") | (F.col("n_tool_calls") == 0))
    role = F.when(F.col("type") == "human", "user").otherwise("assistant")
    return shown.select("thread_id", "idx", role.alias("role"), strip(F.col("content")).alias("content"))


def evidence_ledger(items: DataFrame, capacity: int, queries: int = 6) -> DataFrame:
    """(thread_id, seq, chunk_id, source, page, query, excerpt) -> one row per thread and key, newest kept up to `capacity`.

    The key is the chunk id, else source and page, else the excerpt's digest.
    Later values overwrite, queries gather in order up to `queries`; omitted counts what fell out.
    """
    by_page = F.concat_ws("#", "source", F.col("page").cast("string"))
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), F.when(F.col("source") != "", by_page), F.sha2("excerpt", 256))
    grouped = items.withColumn("key", key).groupBy("thread_id", "key").agg(
        F.max("seq").alias("seq"),
        F.max_by("source", "seq").alias("source"),
        F.max_by("page", "seq").alias("page"),
        F.max_by("excerpt", "seq").alias("excerpt"),
        F.array_sort(F.collect_list(F.struct("seq", "query"))).alias("_q"),
    )
    asked = F.slice(F.array_distinct(F.transform("_q", lambda x: x["query"])), F.lit(1), F.lit(queries))
    back = Window.partitionBy("thread_id").orderBy(F.desc("seq"), "key")
    rows = grouped.withColumn("queries", asked).withColumn("_n", F.row_number().over(back)).withColumn("_all", F.count("*").over(Window.partitionBy("thread_id")))
    kept = rows.where(F.col("_n") <= capacity)
    return kept.select("thread_id", "key", "source", "page", "excerpt", "queries", "seq", F.greatest(F.lit(0), F.col("_all") - capacity).alias("omitted"))


def unseen(history: DataFrame, visible: DataFrame) -> DataFrame:
    """Historical evidence whose key is not in view."""
    return history.join(visible.select("thread_id", "key").distinct(), ["thread_id", "key"], "left_anti")


def merge_log(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The latest row of each id."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("r")).select(*key, "r.*")


def progress(events: DataFrame) -> DataFrame:
    """Without consecutive repeats of a state within a request (request_id, seq, state)."""
    order = Window.partitionBy("request_id").orderBy("seq")
    return events.withColumn("_before", F.lag("state").over(order)).where("not (_before <=> state)").drop("_before")


def compaction_prefix(messages: DataFrame, limit: int, recent: int = 3, overhead: int = 4) -> DataFrame:
    """Earliest turns, the last `recent` left out, while their tokens stay within the limit: thread_id, turn, tokens, compact."""
    sizes = turns(messages).groupBy("thread_id", "turn").agg(F.sum(token_estimate(F.col("content")) + overhead).alias("tokens"))
    ahead = Window.partitionBy("thread_id").orderBy("turn")
    back = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    rows = sizes.withColumn("_sum", F.sum("tokens").over(ahead)).withColumn("_end", F.row_number().over(back))
    return rows.select("thread_id", "turn", "tokens", ((F.col("_end") > recent) & (F.col("_sum") <= limit)).alias("compact"))


def completed_history(messages: DataFrame) -> DataFrame:
    """Completed turns without tools: their human messages and the last AI text of each."""
    rows = completed(messages)
    spoken = rows.where(F.col("type").isin("human", "ai") & (F.length(strip(F.coalesce("content", F.lit("")))) > 0))
    last = F.max(F.when(F.col("type") == "ai", F.col("idx"))).over(Window.partitionBy("thread_id", "turn"))
    return spoken.withColumn("_last", last).where((F.col("type") == "human") | (F.col("idx") == F.col("_last"))).drop("_last")


def without_controls(messages: DataFrame, names: list[str]) -> DataFrame:
    """Without messages that only steer the run, known by their name."""
    return messages.where(~F.coalesce(F.col("name").isin(names), F.lit(False)))


def context_report(messages: DataFrame, limit: int, overhead: int = 4) -> DataFrame:
    """Tokens of a thread by role, of its current turn and of its history, and whether all is within `limit`."""
    rows = turns(messages).withColumn("_t", token_estimate(F.col("content")) + overhead).withColumn("_last", F.max("turn").over(Window.partitionBy("thread_id")))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_t"))), F.lit(0))
    kinds = {k: of(F.col("type") == k).alias(f"{k}_tokens") for k in ("human", "ai", "tool", "system")}
    current = F.col("turn") == F.col("_last")
    return rows.groupBy("thread_id").agg(
        F.sum("_t").alias("total_tokens"), *kinds.values(), of(current).alias("current_tokens"), of(~current).alias("history_tokens"), (F.sum("_t") <= limit).alias("within")
    )


def summary_valid(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(thread_id, ids) of summarised messages -> thread_id, valid: they are exactly the first ones, up to the end of a turn."""
    own = turns(messages)
    last = F.lead("turn").over(_thread())
    rows = own.withColumn("_n", F.row_number().over(_thread())).withColumn("_ends", F.coalesce(last != F.col("turn"), F.lit(True)))
    met = rows.join(summaries.select("thread_id", "ids", F.size("ids").alias("_size")), "thread_id").where(F.col("_n") <= F.col("_size"))
    checked = met.groupBy("thread_id").agg(
        F.count("*").alias("n"), F.first("_size").alias("size"), F.bool_and(F.get("ids", F.col("_n") - 1).eqNullSafe(F.col("idx"))).alias("same"), F.max_by("_ends", "_n").alias("ends")
    )
    all_of = summaries.select("thread_id").join(checked, "thread_id", "left")
    return all_of.select("thread_id", F.coalesce((F.col("n") == F.col("size")) & F.col("same") & F.col("ends"), F.lit(False)).alias("valid"))
