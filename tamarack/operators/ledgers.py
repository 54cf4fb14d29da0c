"""Evidence that a thread's tool results brought: the current turn's, with excerpts, and that of its history, as places only.

Items are (thread_id, seq, rank, chunk_id, source, page, tool_call_id,
message_id, query, excerpt, truncated), one for each piece of evidence of a
successful call; seq orders a thread's messages, rank a message's pieces from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Records of either ledger, their excerpts, queries and ids.
VISIBLE, HISTORICAL, EXCERPT_CHARS, QUERY_CHARS, QUERIES, ID_CHARS = 18, 64, 240, 160, 6, 512


def _at() -> Column:
    return F.struct("seq", "rank")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _fits() -> Column:
    return (F.length(_text("chunk_id")) <= ID_CHARS) & (F.length(_text("source")) <= ID_CHARS)


def _asked(keyed: DataFrame, size: int) -> DataFrame:
    """thread_id, key, queries: the first different ones in order. No more than `size` of a key's are gathered."""
    asked = keyed.where(F.col("query") != "").groupBy("thread_id", "key", "query").agg(F.min(_at()).alias("at"))
    first = asked.withColumn("n", F.row_number().over(Window.partitionBy("thread_id", "key").orderBy("at"))).where(F.col("n") <= size)
    return first.groupBy("thread_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "query"))).alias("q")).select("thread_id", "key", F.col("q.query").alias("queries"))


def _recorded(keyed: DataFrame, facts: dict[str, Column], newest: bool, capacity: int) -> DataFrame:
    """A row for each key that is kept, with facts and queries, and all that its thread omits.

    keyed: items with key (null: no record) and query. Sums of a key are made before its thread's keys are ranked.
    """
    usable = keyed.where("key is not null")
    grouped = usable.groupBy("thread_id", "key").agg(F.min(_at()).alias("first_at"), F.count("*").alias("_rows"), *(value.alias(name) for name, value in facts.items()))
    thread = Window.partitionBy("thread_id")
    ranked = grouped.withColumn("_n", F.row_number().over(thread.orderBy(F.desc("first_at") if newest else F.col("first_at"))))
    kept = ranked.where(F.col("_n") <= capacity).withColumn("_kept", F.sum(F.lit(1) if newest else F.col("_rows")).over(thread))
    # An early key that fell out is one record; a late one that found no room is as many pieces as it had.
    totals = grouped.groupBy("thread_id").agg(F.sum(F.lit(1) if newest else F.col("_rows")).alias("_all"))
    unusable = keyed.where("key is null").groupBy("thread_id").agg(F.count("*").alias("_bad"))
    met = kept.join(_asked(usable, QUERIES), ["thread_id", "key"], "left").join(totals, "thread_id").join(unusable, "thread_id", "left")
    lost = F.col("_all") - F.col("_kept") + F.coalesce("_bad", F.lit(0))
    queries = F.coalesce("queries", F.array().cast("array<string>"))
    return met.select("thread_id", "key", "first_at.seq", "first_at.rank", *facts, queries.alias("queries"), lost.alias("omitted"))


def visible_ledger(items: DataFrame, capacity: int = VISIBLE, chars: int = EXCERPT_CHARS) -> DataFrame:
    """The current turn's evidence: the first `capacity` chunks, each with its longest excerpt.

    A chunk without an id is the call's id and the piece's number from 0. Pieces
    without text count for nothing; such with too long ids, or of chunks that
    came when there was no room, are omitted. Of excerpts of one length the
    first stays. A thread that keeps no record has no row.
    """
    cut = F.left(F.col("excerpt"), F.lit(chars))
    key = F.when(_fits(), F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat_ws(":", _text("tool_call_id"), (F.col("rank") - 1).cast("string"))))
    keyed = items.where(_text("excerpt") != "").withColumns({
        "key": key, "query": F.left(_text("query"), F.lit(QUERY_CHARS)), "truncated": F.coalesce("truncated", F.lit(False)) | (F.length("excerpt") > chars), "excerpt": cut,
    })
    longest = F.max_by(F.struct("excerpt", "truncated"), F.struct(F.length("excerpt"), -F.col("seq"), -F.col("rank")))
    facts = {"source": F.min_by("source", _at()), "page": F.min_by("page", _at()), "_best": longest}
    rows = _recorded(keyed, facts, False, capacity)
    return rows.select("thread_id", "key", "seq", "rank", "source", "page", "_best.excerpt", F.col("_best.truncated").alias("excerpt_truncated"), "queries", "omitted")


def historical_ledger(items: DataFrame, capacity: int = HISTORICAL) -> DataFrame:
    """Places that earlier turns' evidence came from, the newest `capacity` by their first appearance, without texts.

    The key is the chunk id, else source:page where either is known (None for
    no page), else the call's id and the piece's rank; with none of them, or
    ids that are too long, a piece is omitted. Source, page and rank are the first
    piece's, the ids of message and call the last one's. A thread that keeps no record has no row.
    """
    place = F.concat_ws(":", _text("source"), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    chain = F.coalesce(
        F.nullif("chunk_id", F.lit("")), F.when((_text("source") != "") | F.col("page").isNotNull(), place),
        F.when(_text("tool_call_id") != "", F.concat_ws(":", "tool_call_id", F.col("rank").cast("string"))),
    )
    keyed = items.withColumns({"key": F.when(_fits(), chain), "query": F.left(_text("query"), F.lit(QUERY_CHARS))})
    facts = {
        "source": F.min_by("source", _at()), "page": F.min_by("page", _at()),
        "last_tool_message_id": F.max_by(_text("message_id"), _at()), "last_tool_call_id": F.max_by(_text("tool_call_id"), _at()),
    }
    return _recorded(keyed, facts, True, capacity).withColumn("retrieval_status", F.lit("retrieved"))
