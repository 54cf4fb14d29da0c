"""Benchmark decontamination with one Aho-Corasick automaton over item windows.

Words are runs of lower-cased ASCII letters, digits and all non-ASCII
characters. A window is `width` consecutive words of an item; a shorter item is
one window. Texts are scanned once; hits carry word numbers, which map back to
code-point offsets of the original text.

The automaton goes to the executors only while all windows together stay under
`automaton_bytes`; beyond that, windows of texts and items meet in a shuffle
join on a 128-bit digest, with the same results.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize

WIDTH = 10
AUTOMATON_BYTES = 16_000_000
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[str, tuple] = {}


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows(found: list[bytes], width: int) -> list[bytes]:
    if len(found) < width:
        return [b" ".join(found)] if found else []
    return [b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)]


def word_offsets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, text) -> distinct (window, n_words, item_id). Items without an id or without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (w, w.count(b" ") + 1, item)
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for w in windows(words(text), width)
            ]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())],
                ["window", "n_words", "item_id"],
            )

    items = benchmark.where("item_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text"))
    return items.mapInArrow(cut, "window binary, n_words int, item_id string").distinct()


def _automaton(key: str, rows: list[tuple[bytes, int, str]]):
    """Built once in each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        grouped: dict[bytes, tuple[int, list[str]]] = {}
        for window, n, item in rows:
            grouped.setdefault(window, (n, []))[1].append(item)
        machine = ahocorasick.Automaton()
        for window, value in grouped.items():
            machine.add_word(f" {window.decode(errors='surrogateescape')} ", value)
        machine.make_automaton()
        _BUILT[key] = (machine,)
    return _BUILT[key][0]


def _marks(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for start, size in runs:
        edge[start] += 1
        edge[min(n, start + size)] -= 1
    return np.cumsum(edge[:n]) > 0


def _spans(text: bytes, marks: np.ndarray) -> list[dict]:
    """Code-point spans of runs of hit words in the original text."""
    at = word_offsets(text.decode(errors="replace"))
    flips = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [{"start": at[i][0], "end": at[j - 1][1]} for i, j in zip(flips[::2], flips[1::2])]


_SCHEMA = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _emit(ids: list, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    n, hit, items, spans = zip(*rows) if rows else ((), (), (), ())
    arrays = [*ids, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]
    return pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "n_hit", "items", "spans"])


def _by_automaton(docs: DataFrame, rows: list[tuple[bytes, int, str]], keep: list[str]) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def one(text: bytes | None, machine) -> tuple:
        found = words(text)
        if not found or not len(machine):
            return len(found), 0, [], []
        line = b" " + b" ".join(found) + b" "
        runs, items = [], set()
        for end, (n, owners) in machine.iter(line.decode(errors="surrogateescape")):
            runs.append((end, n))
            items.update(owners)
        if not runs:
            return len(found), 0, [], []
        gaps = np.flatnonzero(np.frombuffer(line.decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        last = np.searchsorted(gaps, [end for end, _ in runs])
        marks = _marks(len(found), [(int(k) - n, n) for k, (_, n) in zip(last, runs)])
        return len(found), int(marks.sum()), sorted(items), _spans(text, marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(key, shared.value)
        for batch in batches:
            found = [one(t.as_py(), machine) for t in batch.column(batch.num_columns - 1)]
            yield _emit(batch.columns[:-1], found, keep)

    return docs.select(*keep, "_text").mapInArrow(scan, f"{kinds}, {_SCHEMA}")


def _by_join(docs: DataFrame, gathered: DataFrame, keep: list[str]) -> DataFrame:
    """The same result where the windows are too many for an automaton."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    sizes = sorted(r[0] for r in gathered.select("n_words").distinct().collect())  # `width` values at most
    keyed = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")

    def digest(window: bytes) -> bytes:
        return hashlib.blake2b(window, digest_size=16).digest()

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                out = [(row, i, n, digest(b" ".join(found[i : i + n]))) for n in sizes for i in range(len(found) - n + 1)]
                if out:
                    columns = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["row", "start", "n_words", "digest"]
                    )

    @F.udf("binary", useArrow=True)
    def key(window):
        return digest(window)

    owners = gathered.withColumn("digest", key("window")).select("digest", "item_id")
    cuts = keyed.select("row", "_text").mapInArrow(cut, "row bigint, start int, n_words int, digest binary")
    met = cuts.join(owners.select("digest").distinct(), "digest")
    runs = met.groupBy("row").agg(F.collect_list(F.struct("start", "n_words")).alias("runs"))
    names = met.select("row", "digest").distinct().join(owners, "digest").select("row", "item_id").distinct()
    names = names.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    joined = keyed.join(runs, "row", "left").join(names, "row", "left").select(*keep, "_text", "runs", "items")

    def finish(batches):
        for batch in batches:
            rows = []
            for text, runs_, items in zip(*batch.columns[-3:-2], *(c.to_pylist() for c in batch.columns[-2:])):
                text = text.as_py()
                n = len(words(text))
                marks = _marks(n, [(r["start"], r["n_words"]) for r in runs_ or []])
                rows.append((n, int(marks.sum()), items or [], _spans(text, marks) if marks.any() else []))
            yield _emit(batch.columns[:-3], rows, keep)

    return joined.mapInArrow(finish, f"{kinds}, {_SCHEMA}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, automaton_bytes: int = AUTOMATON_BYTES, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per input row: `keep`, n_words, n_hit, items (sorted ids as text), spans (code points, end exclusive).

    Null and empty texts have no words; an empty benchmark hits nothing; items
    of one id count once; repeated documents each give a row. Other columns are ignored.
    """
    gathered = materialize(item_windows(benchmark, width), "windows")
    size = gathered.agg(F.sum(F.length("window") + F.octet_length("item_id") + 64)).first()[0] or 0
    keep = list(keep)
    docs = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    if size > automaton_bytes:
        return _by_join(docs, gathered, keep)
    return _by_automaton(docs, [(bytes(w), n, i) for w, n, i in gathered.orderBy("window", "item_id").select("window", "n_words", "item_id").collect()], keep)


def without_hits(docs: DataFrame, benchmark: DataFrame, columns: list[str], width: int = WIDTH) -> DataFrame:
    """`columns` of the documents in which no window occurs."""
    return contamination(docs, benchmark, width, keep=tuple(columns)).where("n_hit = 0").select(*columns)
