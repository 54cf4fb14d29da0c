"""Audit of how far the sources of a language diverge in their words.

Terms are encoded as integers throughout: a slice of texts counts its words with
one bincount for each group over the slice's own dictionary, a task holds its counts
under such codes, and each language's kept terms are dealt by hash into chunks of
bounded size. In a chunk, the terms form one sorted dictionary, ids come by
searchsorted, and every group is a dense vector of counts. Ids are in the order
of the terms' UTF-8 bytes, so a stable sort by value breaks ties rightly. Chunks
are scored apart, one at a time in a task; their sums and their best terms are put
together by Spark.

All arithmetic is in whole numbers of 64 bits, exact while a language has fewer
than 9e15 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import drop_tables, materialize

#: Documents of a language that must hold a term, and ranks of terms that are given.
LEAST_DOCS, TERM_RANKS = 10, 10
UNIT = 1_000_000_000
#: Bytes of text counted at a time; rows, and bytes, that a task combines before it hands them on; rows handed on at once; terms, entries and bytes of the entries' terms of a chunk, on average; cells of a dense block.
SLICE_BYTES, COMBINED_ROWS, COMBINED_BYTES, BATCH_ROWS = 1_000_000, 500_000, 1 << 25, 50_000
CHUNK_TERMS, CHUNK_ENTRIES, CHUNK_BYTES, CELLS = 4_096, 1 << 17, 1 << 22, 1 << 17
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("df", pa.int64())])
#: The same rows while a task holds them: a term or name is there once, a row has its codes.
_CODED = pa.schema([(f.name, pa.dictionary(pa.int32(), f.type) if k < 3 else f.type) for k, f in enumerate(_COUNTS)])


def _words(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of the texts in order, A-Z lower-cased, and the number of the first word of each text (and of the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    folded = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    inside = folded != 32
    goes_on = np.concatenate([[False], inside[:-1]])
    begins = offsets - offsets[0]
    goes_on[begins[begins < len(folded)]] = False
    starts = np.flatnonzero(inside & ~goes_on)
    upto = np.cumsum(inside, dtype=np.int32)
    cuts = np.append(upto[starts] - 1, upto[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(folded[inside])])
    return words, np.searchsorted(starts, begins)


def _slice_counts(langs: list[str], sources: list[str], texts: pa.BinaryArray) -> list[pa.RecordBatch]:
    """Counts of one slice of documents, coded; one batch, or none without words."""
    words, at = _words(texts)
    if not len(words):
        return []
    coded = words.dictionary_encode()
    k, ids = len(coded.dictionary), coded.indices.to_numpy()
    groups: dict[tuple[str, str], list[int]] = {}
    for i, key in enumerate(zip(langs, sources)):
        groups.setdefault(key, []).append(i)
    found = []
    for docs in groups.values():
        runs = [ids[at[i] : at[i + 1]] for i in docs]
        n = np.bincount(np.concatenate(runs), minlength=k)
        df = np.bincount(np.concatenate([np.unique(run) for run in runs]), minlength=k)
        there = np.flatnonzero(n)
        found.append((there, n[there], df[there]))
    term, n, df = (np.concatenate(x) for x in zip(*found))
    of = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    names = [pa.array(x, pa.string()).dictionary_encode().take(pa.array(of)) for x in zip(*groups)]
    return [pa.RecordBatch.from_arrays([*names, _coded(term, coded.dictionary), pa.array(n, pa.int64()), pa.array(df, pa.int64())], schema=_CODED)]


def _coded(codes: np.ndarray, values: pa.Array) -> pa.DictionaryArray:
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), values)


def _summed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The coded rows of several batches with one row for each lang, source and term."""
    table = pa.Table.from_batches(parts, _CODED).unify_dictionaries()
    if not table.num_rows:
        return pa.RecordBatch.from_pylist([], _CODED)
    keys = [(np.concatenate([c.indices.to_numpy() for c in column.chunks]), column.chunk(0).dictionary) for column in table.columns[:3]]
    key = np.zeros(table.num_rows, np.int64)
    for codes, values in keys:
        key = key * len(values) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = [pa.array(np.add.reduceat(table[name].to_numpy()[order], first)) for name in ("n", "df")]
    return pa.RecordBatch.from_arrays([*(_coded(codes[order[first]], values) for codes, values in keys), *sums], schema=_CODED)


def _plain(coded: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(c.dictionary_decode() for c in coded.columns[:3]), *coded.columns[3:]], schema=_COUNTS)


def _combined(parts: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches([_plain(_summed(parts))])


def _runs(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of at most `rows` and, where more than one, not above `most` in size."""
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, done + most, "right"))))
        yield begin, end
        begin = end


def _handed_on(coded: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in plain batches, none of many bytes unless one term is."""
    term = coded.column(2)
    lengths = pc.binary_length(term.dictionary).to_numpy()[term.indices.to_numpy()]
    for begin, end in _runs(lengths, SLICE_BYTES, BATCH_ROWS):
        yield _plain(coded.slice(begin, end - begin))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> their counts, combined as far as a bounded number of rows and bytes goes."""
    held, rows, size = [], 0, 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for begin, end in _runs(pc.binary_length(texts).to_numpy(), SLICE_BYTES, len(langs)):
            new = _slice_counts(langs[begin:end], sources[begin:end], texts.slice(begin, end - begin))
            held += new
            rows += sum(x.num_rows for x in new)
            size += sum(x.nbytes for x in new)
            if rows >= COMBINED_ROWS or size >= COMBINED_BYTES:
                held = [_summed(held)]
                rows, size = held[0].num_rows, held[0].nbytes
                if rows >= COMBINED_ROWS // 2 or size >= COMBINED_BYTES // 2:
                    yield from _handed_on(held[0])
                    held, rows, size = [], 0, 0
    if held:
        yield from _handed_on(_summed(held))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, term, n, df, pre-aggregated within each task; a key may come from several."""
    given = docs.select(_or_empty("lang"), _or_empty("source"), _or_empty("text").cast("binary").alias("text"))
    return given.mapInArrow(counted, "lang string, source string, term binary, n bigint, df bigint")


def _or_empty(column: str):
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n and first (one row of each term) of terms that `least_docs` documents of the language hold.

    One shuffle by term serves the sums and the language's document counts.
    """
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    judged = summed.withColumn("docs", F.sum("df").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return judged.where(F.col("docs") >= least_docs).select("lang", "term", "source", "n", "first")


def _parts_of(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / whole) in 64 bits: three digits at a time, as counts are not above their whole."""
    out, rest = np.zeros(np.broadcast(counts, whole).shape, np.int64), counts
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def score_chunk(terms: list[bytes], owners: list[bytes], sources: list[str], counts: list[int], groups: list[str], sizes: list[int], kept: int, cells: int = CELLS) -> Iterator[tuple]:
    """(source, part, item, value) of one chunk: each pair of groups once, and each group's best terms.

    groups are all the language's sources in order, sizes their occurrences of kept terms, kept the number of these.
    """
    # As objects: one very long term would widen every other.
    ids = np.searchsorted(np.array(terms, object), np.array(owners, object))
    rows = {source: i for i, source in enumerate(groups)}
    row = np.array([rows[s] for s in sources])
    n = np.array(counts, np.int64)
    whole = np.array(sizes, np.int64)[:, None] + 2 * kept
    width = max(1, cells // len(groups))
    pairs = np.zeros((len(groups), len(groups)), np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in groups]
    for begin in range(0, len(terms), width):
        inside = (ids >= begin) & (ids < begin + width)
        dense = np.zeros((len(groups), min(width, len(terms) - begin)), np.int64)
        dense[row[inside], ids[inside] - begin] = n[inside]
        p = _parts_of(dense + 2, whole)
        q = _parts_of(dense.sum(0) + 2, whole[:, 0].sum() - 2 * kept * (len(groups) - 1))
        for i in range(len(groups)):
            pairs[i, i + 1 :] += _gap(p[i + 1 :], p[i]).sum(1)
            over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            if len(over):
                value = _gap(p[i, over], q[over])
                top = np.argsort(-value, kind="stable")[:TERM_RANKS]
                best[i] = sorted([*best[i], *((-int(value[t]), begin + int(over[t])) for t in top)])[:TERM_RANKS]
    for i, source in enumerate(groups):
        for value, term in best[i]:
            yield source, "term", terms[term], -value
        for j in range(i + 1, len(groups)):
            yield source, "pair", groups[j].encode(), int(pairs[i, j])


def scores(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, part, item, value of each chunk of kept terms: what :func:`score_chunk` gives.

    langs: lang, groups, sizes, kept and the number of chunks, that terms are dealt into by their hash.
    """
    entries = kept.join(langs.select("lang", "chunks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"), "term", "source", "n")
    told = langs.where("chunks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "groups", "sizes", "kept")

    def score(entries: pa.Table, told: pa.Table) -> pa.Table:
        if not entries.num_rows:
            return out.empty_table()
        language = told.to_pylist()[0]
        found = list(score_chunk(sorted(entries["term"].unique().to_pylist()), *(entries[c].to_pylist() for c in ("term", "source", "n")), *(language[c] for c in ("groups", "sizes", "kept"))))
        source, part, item, value = zip(*found) if found else [()] * 4
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(([language["lang"]] * len(source), source, part, item, value), out)], schema=out)

    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
    return entries.groupBy("lang", "chunk").cogroup(told.groupBy("lang", "chunk")).applyInArrow(score, "lang string, source string, part string, item binary, value bigint")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group lies from the others, and the terms it has more of than its language.

    A null text, lang or source is ''. Every group that occurs is compared with
    the language's other sources, also without terms (value 0 where the language keeps
    none); a group without terms, or a language of one source, has no rows of that part.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = materialize(kept_terms(term_counts(docs), least_docs), "kept-terms")
    groups = docs.select(_or_empty("lang"), _or_empty("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("entries"), F.sum(F.length("term")).alias("bytes"), F.count_if("first").alias("kept"))
    # One row for each language; its list is as long as the rows of pairs that each of its groups must give.
    listed = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept", "entries", "bytes")),
    )
    most = F.greatest(F.col("kept") / CHUNK_TERMS, F.col("entries") / CHUNK_ENTRIES, F.col("bytes") / CHUNK_BYTES)
    langs = materialize(listed.select("lang", F.col("g.source").alias("groups"), F.col("g.n").alias("sizes"), "kept", F.ceil(most).alias("chunks")), "languages")
    scored = materialize(scores(kept, langs).withColumn("item", F.col("item").cast("string")), "scored")
    once = scored.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    bare = langs.where("kept = 0").select("lang", F.explode("groups").alias("source"), "groups").select("lang", "source", F.explode("groups").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = once.unionByName(other).unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = scored.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= TERM_RANKS)
    out = materialize(pairs.unionByName(terms), "audit")
    drop_tables(spark, [kept, langs, scored])
    return out
