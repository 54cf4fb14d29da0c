"""Quality classifier from zstandard dictionaries.

Good and bad labelled text each train a dictionary. A text is compressed in
blocks, all of it, under either dictionary and under none; the difference of
the two sizes over the plain size, with the plain ratio and the length, becomes
a probability by a logistic calibration on labelled blocks' documents that the
dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import labelled_sample

#: Bytes compressed at a time; a dictionary's help fades over longer runs.
BLOCK = 2_048
#: Blocks of either class that train its dictionary, at most.
DICTIONARY_BLOCKS = 3_000
#: Labelled rows that anything is learned from, at most.
LABELLED_ROWS = 10_000
DICTIONARY_BYTES = 65_536
LEVEL = 3
_COMPRESSORS: dict[int, list] = {}


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]  # empty: always `prior`
    prior: float


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own end is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressors(model: QualityModel) -> list:
    key = hash((model.good, model.bad))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for content in (model.good, model.bad, None):
            options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
            if content is not None:
                kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                options["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=kind)
                options["dict_data"].precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(**options).compress)
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def features(text: bytes | None, model: QualityModel) -> list[float]:
    """Normalised size difference, plain ratio and length of a whole text."""
    text = text or b""
    good, bad, plain = _compressors(model)
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    sizes = [sum(len(compress(b)) for b in blocks) for compress in (good, bad, plain)]
    n = len(text)
    weight = n / (n + 200)
    difference = (sizes[1] - sizes[0]) / max(1, sizes[2])
    ratio = sizes[2] / max(1, n)
    return [1.0, weight * difference, (1 - weight) * difference, weight * min(ratio, 1.5), weight * min(ratio, 1.5) ** 2, float(np.log1p(n)) / 10]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, blocks: int = DICTIONARY_BLOCKS, modulus: int = 5, remainder: int = 0) -> QualityModel:
    """Learn from labelled rows that are not held out, in hash order up to the two bounds.

    Six in ten of them give blocks for the dictionaries, the rest the calibration.
    Rows of a null id, label or text teach nothing. With one class alone, the
    score is its smoothed share throughout.
    """
    texts = labelled_sample(docs, labels, "quality", rows, modulus, remainder).withColumn("text", F.col("text").cast("binary"))
    part = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(10))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(BLOCK)))
    pieces = texts.where(part < 6).withColumn("at", at)
    pieces = pieces.select("quality", F.expr(f"substring(text, at, {BLOCK})").alias("piece"), F.xxhash64("doc_id", "at").alias("h"), "doc_id", "at")
    samples = {q: [bytes(r.piece) for r in pieces.where(F.col("quality") == q).orderBy("h", "doc_id", "at").limit(blocks).collect() if len(r.piece) > 7] for q in (0, 1)}
    good, bad = len(samples[1]), len(samples[0])
    if not good or not bad:
        return QualityModel(b"", b"", [], (good + 1) / (good + bad + 2))
    model = QualityModel(_dictionary(samples[1]), _dictionary(samples[0]), [], 0.5)
    fitted = measure(texts.where(part >= 6), model, ["quality", "doc_id"]).orderBy("doc_id").collect()
    y = np.array([r.quality for r in fitted], dtype=float)
    if len(set(y)) < 2:
        model.weights = [0.0, 20.0, 0.0, 0.0, 0.0, 0.0]
    else:
        model.weights = [float(v) for v in _logistic(np.array([r.features for r in fitted]), y)]
    return model


def measure(texts: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), model) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"{schema}, features array<double>")


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """`keep` and score, from 0 (bad) to 1 (good); null and empty texts are scored as no bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(model.weights)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if len(weights):
                x = np.array([features(t.as_py(), model) for t in texts]).reshape(-1, len(weights))
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            else:
                p = np.full(len(texts), model.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*keep, "score"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(scan, f"{schema}, score double")
