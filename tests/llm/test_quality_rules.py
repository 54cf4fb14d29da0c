"""Rule measures and certified cutoffs against plain recounts and exact binomial sums."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tamarack.llm import quality_rules, queries
from tamarack.llm.common import materialize
from tests import oracle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, stratum string, mark bigint, kept string"


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines by lists and sets."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p for places in seen.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines)]


def rows(spark, docs):
    return spark.createDataFrame([(i, t, l, "s", 0, "clash", 1, "clash") for i, t, l in docs], SCHEMA)


def test_measures_are_the_plain_ones(spark):
    rng = random.Random(41)
    texts = [None, "", " \t\n\v\f\r ", "one", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x\n x\nx\n\n \nx", "#*$%&|<> é𝄞  wide space", "w " * 30_000, "a b c d e f " * 2, "a\tb\nc a\vb\fc", "\n".join(["same line"] * 50)]
    texts += [" ".join(rng.choices(["a", "b", "c", "d\n", "é#", "x" * 9], k=rng.randrange(0, 80))) for _ in range(150)]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "one", "en"), (None, "a b c a b c", None)]
    got = sorted((str(r.doc_id), *(r[c] for c in quality_rules.MEASURES)) for r in quality_rules.measure(rows(spark, docs), ["doc_id"]).collect())
    assert got == sorted((str(i), *plain(t)) for i, t, _ in docs)
    assert quality_rules.measure(rows(spark, docs).limit(0), ["doc_id"]).count() == 0


def test_the_tail_is_the_exact_binomial_sum(spark):
    cases = [(0, 1), (0, 300), (1, 300), (3, 5_000), (7, 5_000), (20, 30_000), (5, 5), (10, 1_000)]
    risk = 0.002
    frame = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", quality_rules.log_tail(F.col("k"), F.col("n"), risk).alias("tail"))
    r = Fraction(1, 500)
    for row in frame.collect():
        exact = sum(math.comb(row.n, i) * r**i * (1 - r) ** (row.n - i) for i in range(row.k + 1))
        if row.k >= row.n * risk:
            assert row.tail == 0.0
        else:
            assert row.tail == pytest.approx(math.log(exact), rel=1e-9)


def labelled_corpus(spark, path, n=5_200):
    """Good texts with few symbols; bad ones with many; one language with too few labels; copies, ties, odd rows."""
    rng = random.Random(43)
    text = lambda symbols, size=60: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" + ("#" if rng.random() < symbols else "") for _ in range(size))
    docs, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        docs.append((i, text(0.01 if good else 0.4), "en" if i % 26 else "de"))
        labels.append((i, int(good), 0))
    copy = text(0.9)
    docs += [(10_000 + i, copy, "en") for i in range(300)]  # one good text in 300 copies: one rejection, not 300
    labels += [(10_000 + i, 1, 0) for i in range(300)]
    docs += [(20_000, None, "en"), (20_001, "", None), (20_002, "few words", "en"), (20_003, "same three words " * 40, "en"), (20_004, text(0.4), "en"), (20_005, text(0.4), "de"), (20_006, text(0.0), "xx"), (None, text(0.4), "en"), (0, docs[0][1], "en"), (20_007, "word " * 30_000, "en")]
    labels += [(0, None, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (77_777, 1, 0)]
    rows(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, labels


def test_cutoffs_are_certified_and_bounded(spark, tmp_path):
    path = f"{tmp_path}/a"
    docs, labels = labelled_corpus(spark, path)
    got = queries.op13_quality_rules(spark, path)
    assert oracle.differences(got, queries.OP13_SQL, oracle.connect(path)) == ""
    kept = {(r.doc_id, r.n_symbols): r for r in got.collect()}
    of = lambda i: next(r for (d, _), r in kept.items() if d == i)
    assert not of(20_004).kept and not of(20_004).base_failed  # a certified cutoff of symbols in en
    assert of(20_005).kept and of(20_006).kept  # too few labels for any certificate
    assert of(20_002).base_failed and of(20_003).base_failed and not of(20_003).kept
    good = [i for i in range(5_200) if i % 4 > 0 and i % 26 and i != 5]
    assert sum(not of(i).kept for i in good) <= quality_rules.RISK * len(good)
    measured = materialize(quality_rules.measure(rows(spark, docs).select("doc_id", F.col("lang").alias("stratum"), "text"), ["doc_id", "stratum"]), "measures")
    cutoffs = quality_rules.certify(measured, spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert {(r.stratum, r.rule) for r in cutoffs} == {("en", "symbols")}


def test_without_labels_only_the_fixed_rules_reject(spark):
    docs = rows(spark, [(1, "word " * 60, "en"), (2, " ".join(f"w{k}#" for k in range(60)), "en")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, none).collect()} == {1: False, 2: True}
    assert quality_rules.apply_rules(docs.limit(0), none).count() == 0
