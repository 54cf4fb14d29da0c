"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns look-alike letters of other scripts and digits that
stand for letters into Latin letters, and makes everything else a space, one
character for one. The lexicon has fixed words and words and word beginnings
learned from labelled rows, each weighted by how much likelier it is in toxic
text. A beginning is learned only where several of its words occur in toxic text
and it says more than the commonest of them. Phrases in EXCEPTIONS hide the entries inside them. The hits' weight over
the text's length, with the plain weight, becomes a probability.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import labelled_sample, materialize
from tamarack.llm.quality import _logistic

#: Labelled rows that the lexicon and the calibration are learned from, at most.
LABELLED_ROWS = 12_000
#: Learned entries, at most.
ENTRIES = 3_000
PREFIX = range(5, 11)
#: Toxic documents that a learned entry occurs in at least, as a number and as a share of all.
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.03
#: Letters that a learned entry has at least: shorter words are common ones, and digits fold into too many of them.
LETTERS = 4
#: Toxic documents of a beginning, at least, for one of its commonest word.
MORE = 1.25

# Words that count before anything is learned, and phrases in which they don't.
WORDS = "idiot moron stupid scum trash loser clown pathetic worthless disgusting imbecile dumbass bastard asshole bitch retard jackass scumbag dickhead".split()
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "class clown", "clown fish", "circus clown", "pathetic fallacy", "sore loser", "worthless check", "pond scum", "idiot proof"]
FIXED_WEIGHT = 5.0

# Look-alikes as pairs of the sign and its Latin letter.
_ALIKE = "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd ԛq ԝw һh ӏi ґr αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ıi ℓi ƒf ɑa ɡg ʏy ᴏo ꜱs"
_DIGITS = "0o 1i 3e 4a 5s 7t 8b 9g"
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: Signs inside a word; before one, a dollar ahead of a letter and an at ahead of ss ("@name" is a mention, "$5" a price).
_SIGN = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])|(?<![^\W_])(?:\$+(?=[^\W\d_])|@(?=[sS]{2}))")
_DROPPED = re.compile("[­̀-ͯ​-‏⁠﻿]")
_BUILT: dict[str, object] = {}


def _tables() -> tuple[dict[int, str], dict[int, str]]:
    fold: dict[int, str] = {c: " " for c in [*range(128), *range(0xA0, 0xC0), *range(0x2000, 0x2070), *range(0x3000, 0x3010)]}
    for c in [*range(65, 91), *range(97, 123)]:
        fold[c] = chr(c).lower()
    for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        if len(chr(c).lower()) == 1:
            fold[c] = chr(c).lower()
    for c in [*range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0x24B6, 0x24EA)]:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii() and base.isalnum():
            fold[c] = base
    for sign, letter in (p for p in _ALIKE.split()):
        for form in {sign, sign.upper()[0]}:
            fold[ord(form)] = letter
    for c, to in fold.items():
        digit = chr(c) if chr(c).isascii() else to
        for d, letter in (p for p in _DIGITS.split()):
            if digit == d:
                fold[c] = letter
        if fold[c] == "l":  # 1 stands for either
            fold[c] = "i"
    strip = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii() and base.isalpha():
            strip[c] = "i" if base == "l" else base
    return fold, strip


_FOLD, _STRIP = _tables()


def fold(text: str) -> tuple[str, list[int] | None]:
    """Folded text and, if characters were dropped, the place of each kept one in the original."""
    kept = None
    if not text.isascii() and _DROPPED.search(text):
        kept = [i for i, c in enumerate(text) if not _DROPPED.match(c)]
        text = "".join(text[i] for i in kept)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: "".join(_SIGNS[c] for c in m[0]), text)
    return text.translate(_FOLD), kept


@dataclass
class ToxicityModel:
    entries: dict[str, float]  # folded pattern between spaces, or after one, and its weight; exceptions weigh 0
    weights: list[float]
    prior: float


def _entry(phrase: str) -> str:
    return f" {fold(phrase)[0]} "


def _automaton(key: str, entries: dict[str, float]):
    """Built once in each Python worker: all entries, and those of ASCII letters alone for texts without accents."""
    if key not in _BUILT:
        _BUILT.clear()
        made = []
        for wanted in (entries, {p: w for p, w in entries.items() if p.isascii() and p.endswith(" ")}):
            machine = ahocorasick.Automaton()
            for pattern, weight in wanted.items():
                machine.add_word(pattern, (len(pattern), weight))
            machine.make_automaton()
            made.append(machine)
        _BUILT[key] = made
    return _BUILT[key]


def hits(text: str, machines) -> tuple[int, list[tuple[int, int, float]]]:
    """Words in the text, and (start, end, weight) of the heaviest entry at each word, in the original's code points."""
    folded, kept = fold(text)
    n = len(folded.split())
    line = f" {folded} "
    best: dict[int, tuple[int, float]] = {}
    hidden: list[tuple[int, int]] = []
    lines = [(line, machines[0])]
    if not line.isascii():
        lines.append((line.translate(_STRIP), machines[1]))
    for some, machine in lines:
        for end, (size, weight) in machine.iter(some) if len(machine) else ():
            start = end - size + 1
            if not weight:
                hidden.append((start, end))
            elif weight > best.get(start, (0, 0.0))[1]:
                best[start] = (end, weight)
    found = []
    for start, (end, weight) in sorted(best.items()):
        if any(a <= start < b for a, b in hidden):
            continue
        stop = end if line[end] == " " else end + 1
        a, b = start, stop - 1  # without the leading space that `line` has before the text
        if kept:
            a, b = kept[a], kept[b - 1] + 1
        if any(c.isalpha() for c in text[a:b]):
            found.append((a, b, weight))
    return n, found


def features(text: str | None, machines) -> list[float]:
    n, found = hits(text or "", machines)
    weight = sum(w for _, _, w in found)
    return [1.0, float(np.log1p(200 * weight / (n + 5))), float(np.log1p(weight)), float(np.log1p(len(found)))]


def _statistics(texts: DataFrame) -> DataFrame:
    """(toxic, text) -> pattern, documents of either class that have it, the toxic ones of its commonest word, and its words in toxic text.

    The empty pattern counts all documents; a whole word is its own only word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(fold(text.as_py())[0].split())
                own = {""} | {f" {w} " for w in words} | {f" {w[:size]}" for w in words for size in PREFIX if size <= len(w)}
                seen.update((pattern, toxic) for pattern in own)
            columns = [[p for p, _ in seen], [t for _, t in seen], list(seen.values())]
            kinds = (pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["pattern", "toxic", "d"])

    counted = texts.select("toxic", "text").mapInArrow(count, "pattern string, toxic int, d bigint")
    of = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("d")).otherwise(0))
    found = materialize(counted.groupBy("pattern").agg(of(1).alias("dt"), of(0).alias("dc")), "toxicity-counts")
    word = F.rtrim("pattern")
    begun = F.explode(F.transform(F.sequence(F.lit(PREFIX.start), F.least(F.length(word) - 1, F.lit(PREFIX.stop - 1))), lambda n: F.left(word, n + 1)))
    whole = found.where(F.endswith("pattern", F.lit(" ")) & (F.col("dt") > 0) & (F.length(word) > PREFIX.start))
    completed = whole.select(begun.alias("pattern"), F.col("dt").alias("of_word")).groupBy("pattern").agg(F.max("of_word").alias("most"), F.count("*").alias("words"))
    return found.join(completed, "pattern", "left").withColumns({"most": F.coalesce("most", F.lit(0)), "words": F.coalesce("words", F.lit(1))})


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, modulus: int = 4, remainder: int = 2) -> ToxicityModel:
    """Learn from labelled rows that are not held out, in hash order up to `rows`.

    Two in three of them give the lexicon, the rest the calibration. Rows of a
    null id, label or text teach nothing. With one class alone the fixed words
    count and the calibration is fixed.
    """
    texts = labelled_sample(docs, labels, "toxic", rows, modulus, remainder)
    first = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(3)) < 2
    statistics = _statistics(texts.where(first))
    whole = statistics.where("pattern = ''").first()
    entries = {_entry(w): FIXED_WEIGHT for w in WORDS}
    if whole and whole.dt and whole.dc:
        rate = F.log((F.col("dt") + 0.5) / whole.dt / ((F.col("dc") + 0.5) / whole.dc))
        expected = (F.col("dt") + F.col("dc")) * (whole.dt / (whole.dt + whole.dc))
        learned = statistics.select("pattern", F.least(rate, F.lit(6.0)).alias("weight"), ((F.col("dt") - expected) / F.sqrt(expected + 1)).alias("z"), "dt", "most", "words")
        least = max(LEAST_DOCUMENTS, LEAST_SHARE * whole.dt)
        learned = learned.where((F.col("pattern") != "") & (F.col("dt") >= least) & (F.col("weight") > 1.1) & (F.col("z") > 4))
        learned = learned.where(F.length(F.trim("pattern")) >= LETTERS)
        learned = learned.where(F.endswith("pattern", F.lit(" ")) | ((F.col("words") > 1) & (F.col("dt") >= MORE * F.col("most"))))
        entries |= {r.pattern: r.weight for r in learned.orderBy(F.desc("z"), "pattern").limit(ENTRIES).collect()}
    entries |= {_entry(p): 0.0 for p in EXCEPTIONS}
    model = ToxicityModel(entries, [-4.0, 1.0, 0.5, 0.5], 0.5)
    measured = measure(texts.where(~first), model, ["toxic", "doc_id"]).orderBy("doc_id").collect()
    y = np.array([r.toxic for r in measured], dtype=float)
    if len(set(y)) == 2:
        model.weights = [float(v) for v in _logistic(np.array([r.features for r in measured]), y)]
    return model


def _apply(rows: DataFrame, model: ToxicityModel, keep: list[str], name: str, kind: str, of) -> DataFrame:
    key, entries = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(model.entries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _automaton(key, entries.value)
        for batch in batches:
            out = of([t.as_py() for t in batch.column(batch.num_columns - 1)], machines)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*keep, name])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, F.col("text").alias("_text")).mapInArrow(scan, f"{schema}, {name} {kind}")


def measure(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    of = lambda texts, machines: pa.array([features(t, machines) for t in texts], pa.list_(pa.float64()))
    return _apply(rows, model, keep, "features", "array<double>", of)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """`keep` and score, from 0 (clean) to 1 (toxic). Null and empty texts score as texts without hits."""

    def of(texts, machines):
        x = np.array([features(t, machines) for t in texts]).reshape(-1, len(model.weights))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))))

    return _apply(docs, model, keep, "score", "double", of)


def spans(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and spans (start, end in code points, weight) of the entries that counted."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
    of = lambda texts, machines: pa.array([[dict(zip(("start", "end", "weight"), h)) for h in hits(t or "", machines)[1]] for t in texts], kind)
    return _apply(docs, model, ["doc_id"], "spans", "array<struct<start:int,end:int,weight:double>>", of)
