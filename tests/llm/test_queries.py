"""The thin queries over small tables of their own, against plain recounts."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import embedding_dedup, quality, queries, secret_scan, simhash, token_counts, toxicity
from tamarack.llm.common import labelled_sample, materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, tidy string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def folder(spark, tmp_path, name, docs):
    path = f"file://{tmp_path}/{name}"
    spark.createDataFrame([(i, t, l, s, len(t or ""), "clash", "clash") for i, t, l, s in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_the_rollup_counts_repeats_null_ids_and_ties_once(spark, tmp_path):
    rng = random.Random(13)
    docs = [(1, "alpha  beta", "en", "s"), (1, "alpha  beta", "en", "s"), (2, "x y", "en", "s"), (None, "un  named", "en", "s"), (None, "un  named", "de", "s"), (None, None, None, None), (4, None, "en", "t"), (5, "", "en", "t")]
    docs += [(10 + i, "common  text  here", "en", f"s{i % 3}") for i in range(40)] + [(3, "alpha  beta", "fr", "s")]
    docs += [(100 + i, words(rng, 30) + rng.choice(["", "  tail\t"]), "en", "s") for i in range(60)] + [(200, "word " * 5_000, "en", "long")]
    encode = token_counts._encoder(token_counts.VOCABULARY).encode_ordinary
    kept = {}
    for i, t, l, s in docs:
        row = (i is None, i if i is not None else 0, s is not None, s or "", l is not None, l or "", s, l)
        kept[t or ""] = min(row, kept.get(t or "", row))
    want = {}
    for t, row in kept.items():
        tidy = re.sub(r"[ \t]+", " ", t).strip(" ")
        total = want.setdefault(row[-2:], [0, 0])
        total[0] += 1
        total[1] += len(encode(tidy))
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in queries.op1_token_rollup(spark, folder(spark, tmp_path, "a", docs)).collect()}
    assert got == {k: v for k, v in want.items() if any(v)}
    assert queries.op1_token_rollup(spark, folder(spark, tmp_path, "none", [])).count() == 0


def plain_features(value, entries):
    """Entries found by plain search at every place, the heaviest at each, exceptions hiding what begins in them."""
    folded, kept = toxicity.fold(value or "")
    best, hidden = {}, []
    lines = [(f" {folded} ", entries)]
    if not folded.isascii():
        lines.append((f" {folded} ".translate(toxicity._STRIP), {p: w for p, w in entries.items() if p.isascii() and p.endswith(" ")}))
    for line, some in lines:
        for pattern, weight in some.items():
            at = line.find(pattern)
            while at >= 0:
                if not weight:
                    hidden.append((at, at + len(pattern) - 1))
                elif weight > best.get(at, (0, 0))[1]:
                    best[at] = (at + len(pattern) - 1, weight)
                at = line.find(pattern, at + 1)
    line = f" {folded} "
    found = []
    for at, (end, weight) in sorted(best.items()):
        stop = end if line[end] == " " else end + 1
        a, b = at, stop - 1
        if kept:
            a, b = kept[a], kept[b - 1] + 1
        if not any(x <= at < y for x, y in hidden) and any(c.isalpha() for c in (value or "")[a:b]):
            found.append(weight)
    total = sum(found)
    return [1.0, math.log1p(200 * total / (len(folded.split()) + 5)), math.log1p(total), math.log1p(len(found))]


def test_toxicity_is_plain_search(spark, tmp_path):
    rng = random.Random(19)
    bad = ["idiot", "1d10t", "ïdiöt", "trash can", "tr@sh", "scum", "grobble", "grobbled", "class clown", "сlоwn", "ID​IOT", "pond scum", "idiotically"]
    docs = [(i, " ".join(rng.choice(bad) if rng.random() < 0.2 else f"w{rng.randrange(50)}" for _ in range(40)) if i % 3 == 0 else words(rng, 40), "en", "s") for i in range(300)]
    docs += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "idiot " * 20_000, "en", "s"), (3, docs[3][1], "en", "s"), (None, "idiot", "en", "s")]
    path = folder(spark, tmp_path, "a", docs)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 0), (0, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    rows = queries.op3_toxicity(spark, path).collect()
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), labels)
    want = []
    for i, t, _, _ in docs:
        score = 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(plain_features(t, model.entries), model.weights))))))
        want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 4 == 2, round(score, 9), int(score >= 0.3)))
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in rows) == sorted(want)


def test_quality_is_the_difference_of_plain_sizes(spark, tmp_path):
    rng = random.Random(29)
    docs = [(i, words(rng, 150) if i % 2 else " ".join(f"BUY{rng.randrange(9)}!!" for _ in range(120)), "en", "s") for i in range(200)]
    docs += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "é" * 100_000, "en", "s"), (1, docs[1][1], "en", "s"), (None, "x", "en", "s")]
    path = folder(spark, tmp_path, "a", docs)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    rows = queries.op10_quality(spark, path).collect()
    model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), labels)

    def size(raw, dictionary):
        """Blocks compressed one by one with a compressor of their own."""
        total = 0
        for at in range(0, len(raw), quality.BLOCK):
            options = {"level": quality.LEVEL, "write_content_size": False, "write_dict_id": False}
            if dictionary is not None:
                kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                options["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
                options["dict_data"].precompute_compress(level=quality.LEVEL)
            total += len(zstandard.ZstdCompressor(**options).compress(raw[at : at + quality.BLOCK]))
        return total

    want = []
    for i, t, _, _ in docs:
        raw = (t or "").encode()
        good, bad, plain = (size(raw, d) for d in (model.good, model.bad, None))
        n, weight = len(raw), len(raw) / (len(raw) + 200)
        difference, ratio = (bad - good) / max(1, plain), min(plain / max(1, n), 1.5)
        x = [1.0, weight * difference, (1 - weight) * difference, weight * ratio, weight * ratio**2, math.log1p(n) / 10]
        score = 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.weights))))))
        want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(score, 6), int(score >= 0.3)))
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6), r.predicted) for r in rows) == sorted(want)


@pytest.mark.parametrize("size", [8, 16, 64, 128])
def test_filters_find_nine_in_ten_pairs_of_any_size(spark, size):
    """Through the whole operator, with so small buckets that filters are made."""
    rng = np.random.default_rng(size)
    rows = []
    for x, y in list(embedding_dedup._pairs_at(size, 0.9001, rng))[:150]:
        rows += [(len(rows), x.tolist()), (len(rows) + 1, y.tolist())]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    units = np.array([v for _, v in rows])
    close = np.triu(units @ units.T >= 0.9, 1)
    got = embedding_dedup.near_duplicates(frame, block=20).collect()
    assert embedding_dedup.plan(size, 300, 0.9, 20).tables > 0
    found = sum(r.n_links for r in got)
    assert 0.9 * 2 * close.sum() <= found <= 2 * close.sum()


@pytest.mark.parametrize("size", [96, 384, 768])
def test_plans_of_wide_vectors(size):
    made = embedding_dedup.plan(size, 100_000)
    met = [bool(np.intersect1d(made.decode(x), made.decode(y)).size) for x, y in list(embedding_dedup._pairs_at(size, 0.9, np.random.default_rng(77)))[:150]]
    assert made.tables > 0 and np.mean(met) >= 0.9


def test_markov_spans_are_the_plain_ratio(spark):
    rng = random.Random(37)
    labelled = spark.createDataFrame([("".join(rng.choices("abcdef0123456789XYZ", k=30)), 1) for _ in range(80)] + [("customer_order_history", 0), ("application/json", 0)] * 40, "token string, label int")
    model = secret_scan.fit(labelled)
    counts = {c: {} for c in (0, 1)}
    for r in labelled.collect():
        for pair in zip(r.token, r.token[1:]):
            counts[r.label][pair] = counts[r.label].get(pair, 0) + 1
    k = len(secret_scan.ALPHABET)

    def log(label, a, b):
        line = sum(n for (x, _), n in counts[label].items() if x == a)
        return math.log((counts[label].get((a, b), 0) + secret_scan.SMOOTHING) / (line + secret_scan.SMOOTHING * k))

    tokens = ["".join(rng.choices("abcdef0123456789XYZ", k=26)) for _ in range(60)] + ["customer_order_history_table", "=" * 40, "a" * 19]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)] + [(900, None), (901, "")], "doc_id bigint, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == secret_scan.KINDS.index("markov")] for r in secret_scan.scan(docs, model).collect()}
    for i, t in enumerate(tokens):
        mean = sum(round(1000 * (log(1, a, b) - log(0, a, b))) for a, b in zip(t, t[1:])) / (len(t) - 1)
        assert found[i] == ([(4, 4 + len(t))] if len(t) >= 20 and mean >= secret_scan.THRESHOLD else []), t


def brute_groups(texts, least=0.8, width=5):
    grams = [simhash.shingles(t.encode(), width) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_recall_of_the_near_duplicate_stage(spark):
    """Groups with copies of every likeness, over the production radius: nine in ten documents that should go do, and no other."""
    rng = random.Random(43)
    texts = []
    for _ in range(40):
        body = words(rng, rng.choice([40, 120, 400]), 10**6).split()
        texts.append(" ".join(body))
        for _ in range(rng.randrange(4)):
            copy = list(body)
            for _ in range(max(1, int(len(copy) * rng.uniform(0, 0.03)))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    group = brute_groups(texts)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()}
    should_go = {i for i in range(len(texts)) if any(group[j] == group[i] for j in range(i))}
    assert not (set(range(len(texts))) - kept) - should_go
    assert len(should_go - kept) >= 0.9 * len(should_go)


def test_stages_of_odd_tables(spark, tmp_path):
    rng = random.Random(47)
    docs = [(i, words(rng, 60), "en", "s") for i in range(60)] + [(60 + i, " ".join(f"BUY{rng.randrange(9)}!!" for _ in range(60)), "en", "s") for i in range(30)]
    docs += [(None, None, None, None), (None, "lone text of a null id", "en", None), (500, None, "en", "s"), (501, "", "en", "s"), (1, docs[1][1], "en", "s"), (502, "x" * 100_000, "en", "s")]
    for name, rows in (("a", docs), ("none", [])):
        path = folder(spark, tmp_path, name, rows)
        spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, words(rng, 30))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
        frame = spark.read.parquet(f"{path}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            frame = materialize(run(spark, frame, path), stage)
        ids = [r.doc_id for r in frame.collect()]
        assert len([i for i in ids if i is not None and i < 60]) >= 58 * bool(rows) and ids.count(1) <= 1
        assert not rows or {"doc_id", "taken"} <= set(frame.columns)
    assert frame.where(F.lit(True)).count() == 0


def test_signs_at_a_word_s_start_are_folded():
    plain = {"$hit": "shit", "@sshole": "asshoie", "a $1d10t": "a  idiot", "$5": " s", "@idiot": " idiot", "x |idiot|": "x  idiot ", "sh!t": "shit"}
    assert {k: toxicity.fold(k)[0] for k in plain} == plain


def test_a_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "two"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    rows = labelled_sample(docs, labels, "quality", 10, 5, 7).collect()
    assert sorted((r.doc_id, r.text, r.quality) for r in rows) == [(1, "text 0", 1), (2, "two", 0)]
