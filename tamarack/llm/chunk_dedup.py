"""Repeated passages found by content-defined chunking.

A gear hash rolls over the bytes; its low sixteen bits depend on the last sixteen
bytes alone. A place is a cut where they fall under a bound and no other such
place lies within the LEAST bytes before it, so cuts depend on nearby content
only and an insertion shifts nothing beyond it. From every chunk a window runs
on over whole chunks until it has PASSAGE_WORDS words. Windows are matched by a
strong digest, so whatever is found stands as it is, and as long, in one other
document; overlapping shared windows make up a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize

#: One byte in RATE is a cut before the least distance; runs over MOST bytes are cut anyway.
RATE, LEAST, MOST = 20, 10, 256
#: Words that a shared passage has at least, some thirty tokens.
PASSAGE_WORDS = 20
_GEAR = np.random.default_rng(20_240_101).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: np.ndarray, rate: int = RATE, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of a byte array, its own end last; never inside a UTF-8 character."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    rolled = _GEAR[data]
    for width in (1, 2, 4, 8):  # doubles the window: hash over 2 * width bytes from two over width
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint16(width))
    starts = np.ones(n + 1, bool)
    starts[:n] = (data & 0xC0) != 0x80
    marked = np.flatnonzero((rolled < 65_536 // rate) & starts[1:]) + 1
    if len(marked):
        marked = marked[np.diff(marked, prepend=-least) >= least]
    ends = np.append(marked[marked < n], n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > most:
        extra = [at for end, gap in zip(ends[gaps > most], gaps[gaps > most]) for at in range(end - gap + most, end, most)]
        places = np.flatnonzero(starts)
        ends = np.union1d(ends, places[np.searchsorted(places, np.array(extra))])
    return ends


def windows(raw: bytes, least_words: int) -> tuple[np.ndarray, ...] | None:
    """begin, end (bytes), start, size (code points), first word and number of words of every window; None without any.

    A window is the fewest whole chunks from a cut on that have `least_words`
    words; the last one also has a twin that runs to the end of the text.
    """
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    space = np.concatenate([[True], _SPACE[data]])
    words = np.concatenate([[0], np.cumsum(space[:-1] & ~space[1:])])
    begins = np.concatenate([[0], ends[:-1]])
    past = np.searchsorted(words[ends], words[begins] + least_words)
    chunk = np.flatnonzero(past < len(ends))
    if not len(chunk):
        return None
    past = past[chunk]
    if past[-1] < len(ends) - 1:
        chunk, past = np.append(chunk, chunk[-1]), np.append(past, len(ends) - 1)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin, end = begins[chunk], ends[past]
    return begin, end, letters[begin], letters[end] - letters[begin], words[begin], words[end] - words[begin]


#: Place of a window in two numbers, for narrow shuffles: start and first word, size and number of words.
_PLACE = ["start_word", "size_words"]


def _ranks(ids: pa.Array) -> np.ndarray:
    """Place of each id among the batch's ids in order."""
    out = np.empty(len(ids), np.int64)
    out[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))
    return out


def window_table(docs: DataFrame, strong: bool, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, h and, if `strong`, h2 and the place (in code points and in words) of each window.

    If not strong, a batch of rows gives the least and the greatest id of each h only. h and h2 are the halves of a 128-bit digest. Null and empty texts, and those of fewer words, have no windows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list] | None:
        rows, digests, places = [], [], []
        for row, text in enumerate(part.column(1)):
            raw = text.as_py()
            own = windows(raw, least_words) if raw else None
            if own is not None:
                digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(own[0].tolist(), own[1].tolist())]
                places.append(own[2:])
                rows.append(np.full(len(own[0]), row))
        return (np.concatenate(rows), np.frombuffer(b"".join(digests), "<i8"), places) if rows else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                if (own := found(part)) is None:
                    continue
                if strong:
                    columns = [part.column(0).take(pa.array(own[0])), pa.array(own[1][::2]), pa.array(own[1][1::2])]
                    start_of, size, word, n = (np.concatenate(c) for c in zip(*own[2]))
                    columns += [pa.array((start_of << 32) + word), pa.array((size << 32) + n)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "h2", *_PLACE])
                else:
                    rows.append(own[0] + start)
                    hashes.append(own[1][::2])
            if rows:  # of a window's rows in a batch the first and the last say whether documents share it
                rows, hashes = np.concatenate(rows), np.concatenate(hashes)
                order = np.lexsort((_ranks(batch.column(0))[rows], hashes))
                turns = np.flatnonzero(np.diff(hashes[order]))
                kept = np.unique(np.concatenate([order[np.append(0, turns + 1)], order[np.append(turns, len(order) - 1)]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[kept])), pa.array(hashes[kept])], ["doc_id", "h"])

    more = ", h2 bigint" + "".join(f", {c} bigint" for c in _PLACE) if strong else ""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"doc_id {kind}, h bigint{more}")


def shared_windows(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """Windows that documents of different ids share: doc_id, h, h2, their place, and first_doc_id, the least id that has them.

    Half digests are grouped first, which picks the few rows that a whole digest
    and its join are worth; those rows are written, so that texts are cut twice
    and no more. Rows without an id take no part; rows of one id are one document.
    """
    docs = docs.where("doc_id is not null")
    both = [F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id")]
    # Rows are dealt in the order of their documents, which packs better than partial sums would; common windows are thinned before.
    halves = window_table(docs, False, least_words).repartition("h").groupBy("h").agg(*both).where("first_doc_id <> last_doc_id").select("h")
    likely = materialize(window_table(docs, True, least_words).join(halves, "h", "left_semi"), "windows")
    known = likely.groupBy("h", "h2").agg(*both).where("first_doc_id <> last_doc_id").drop("last_doc_id")
    return likely.join(materialize(known, "shared-windows"), ["h", "h2"])


class _Sweep:
    """Runs through a document's shared windows by start and gives non-overlapping pieces, each of the least first document of the windows over it."""

    def __init__(self, whole: bool):
        self.whole, self.out, self.open, self.at, self.held = whole, [], [], None, None

    def _piece(self, doc, begin: tuple, end: tuple) -> None:
        """begin, end: (code point, word)."""
        owner = min(w[0] for w in self.open)
        marks = [w[3] for w in self.open if w[2] == begin]
        held = self.held
        if self.whole and held and held[0] == doc and held[2] == begin and held[3] == owner:
            held[2], held[5] = end, held[5] + len(marks)
            held[4].update(b"".join(marks))
            return
        self.close()
        self.held = [doc, begin, end, owner, hashlib.sha256(b"".join(marks)), len(marks)]

    def close(self) -> None:
        if self.held:
            doc, begin, end, owner, digest, n = self.held
            self.out.append((doc, begin[0], end[0], end[1] - begin[1], n, owner, digest.hexdigest()))
        self.held = None

    def upto(self, doc, place: tuple | None) -> None:
        """Give what lies before `place`, or all of the document."""
        while self.open and (place is None or self.at < place):
            nearest = min(w[1] for w in self.open)
            stop = nearest if place is None else min(nearest, place)
            if stop > self.at:
                self._piece(doc, self.at, stop)
            self.at = stop
            self.open = [w for w in self.open if w[1] > stop]

    def add(self, owner, begin: tuple, end: tuple, mark: bytes) -> None:
        if not self.open:
            self.at = begin
        if (owner, end, begin, mark) not in self.open[-2:]:
            self.open.append((owner, end, begin, mark))


def _swept(docs: DataFrame, least_words: int, whole: bool) -> DataFrame:
    met = shared_windows(docs, least_words).repartition("doc_id").sortWithinPartitions("doc_id", *_PLACE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "end", "n_words", "n_windows", "first_doc_id", "passage_digest"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, doc, kinds = _Sweep(whole), None, None
        # A row's sort key is its document; only the windows over one place are held.

        def given() -> pa.RecordBatch:
            columns = list(zip(*state.out))
            state.out = []
            types = (kinds[0], pa.int32(), pa.int32(), pa.int64(), pa.int64(), kinds[1], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            kinds = (batch.column(0).type, batch.column(5).type)
            halves = np.stack([np.asarray(batch.column(k)) for k in (1, 2)], axis=1).astype("<i8")
            for row, (own, _, _, place, extent, owner) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if own != doc:
                    state.upto(doc, None)
                    doc = own
                begin, end = place, place + extent
                state.upto(doc, divmod(begin, 1 << 32))
                state.add(owner, divmod(begin, 1 << 32), divmod(end, 1 << 32), halves[row].tobytes())
            if state.out:
                yield given()
        state.upto(doc, None)
        state.close()
        if state.out:
            yield given()

    made = f"doc_id {kind}, start int, end int, n_words bigint, n_windows bigint, first_doc_id {kind}, passage_digest string"
    return met.select("doc_id", "h", "h2", *_PLACE, "first_doc_id").mapInArrow(sweep, made)


def shared_chunks(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """The shared passages chunk by chunk: doc_id, start, end, n_words, digest, first_doc_id."""
    return _swept(docs, least_words, False).select("doc_id", "start", "end", "n_words", F.col("passage_digest").alias("digest"), "first_doc_id")


def passages(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """Passages that documents share, wherever they stand.

    doc_id, start, end (code points of the document), n_words, n_windows (that
    begin in it), first_doc_id and passage_digest. Every place of a passage lies in `least_words` words or
    more that another document has as they are; first_doc_id is the least id
    that has such words there, and a passage ends where it changes. A document without
    passages has no row. Every sharing document has its rows, the first included.
    """
    return _swept(docs, least_words, True)


def drop_passages(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, text without the passages that a document of a smaller id has too."""
    spans = passages(docs, least_words).where("first_doc_id < doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))
    text = F.col("text")

    def step(acc, s):
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out"))

    done = F.aggregate("cut", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    kept = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", F.when(F.col("cut").isNotNull(), kept).otherwise(text).alias("text"))
