"""The source audit against plain counts, and its SQL over odd tables."""

import random
import re

import numpy as np
import pyarrow as pa

from tamarack.llm import divergence, queries
from tests import oracle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, n int, df int"
WORDS = ["Alpha", "beta", "BETA", "été", "Été", "日本", "x", "don't", "a1b", "gamma", "delta", "z" * 3_000]


def plain(docs, least):
    """lang, source, part, item, value, rank by dictionaries alone."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(l or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(fold))) for _, t, l, s in docs]
    out = []
    for lang in {l for l, _, _ in found}:
        df, n = {}, {}
        for l, s, w in found:
            if l == lang:
                n.setdefault(s, {})
                for term in set(w):
                    df[term] = df.get(term, 0) + 1
                for term in w:
                    n[s][term] = n[s].get(term, 0) + 1
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        share = lambda counts: {t: 1 + 10**9 * (counts.get(t, 0) + 2) // (sum(counts.get(x, 0) for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(n[s]) for s in n}
        q = share({t: sum(n[s].get(t, 0) for s in n) for t in kept})
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in n if o != s))
            terms = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if n[s].get(t) and p[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -value, k + 1) for part, rows in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(rows)]
    return sorted(out)


def odd_docs():
    rng = random.Random(31)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "é", None])) for i in range(400)]
    docs += [(900, None, "en", "only-null"), (901, "", "fr", "a"), (902, "", "fr", "b"), (903, "alone", "it", "a"), (904, "word " * 50_000, "en", "long"), (None, "Beta", None, None)]
    return docs + docs[:5] + [(1, "tie up", "xx", f"t{k}") for k in range(3) for _ in range(12)]


def frame_of(spark, docs):
    return spark.createDataFrame([(i, t, l, s, 0, "clash", 1, 2) for i, t, l, s in docs], SCHEMA)


def rows_of(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


def test_the_audit_is_the_plain_one(spark, tmp_path):
    docs = odd_docs()
    frame = frame_of(spark, docs)
    assert rows_of(divergence.audit(frame)) == plain(docs, 10)
    assert rows_of(divergence.audit(frame, least_docs=1)) == plain(docs, 1)
    assert divergence.audit(frame.limit(0)).count() == 0
    path = f"{tmp_path}/a"
    frame.write.parquet(f"{path}/documents.parquet")
    assert oracle.differences(queries.op12_source_audit(spark, path), queries.OP12_SQL, oracle.connect(path)) == ""


def test_slices_and_combined_rows_change_nothing():
    texts = pa.array([b"a b a", b"", b"B c", b"a"])
    whole = divergence._combined(divergence._slice_counts(["l"] * 4, ["s", "s", "t", "t"], texts)).sort_by([("source", "ascending"), ("term", "ascending")])
    parts = [b for k in range(4) for b in divergence._slice_counts(["l"], [["s", "s", "t", "t"][k]], texts.slice(k, 1))]
    assert divergence._combined(parts).sort_by([("source", "ascending"), ("term", "ascending")]).equals(whole)
    assert whole.to_pylist()[0] == {"lang": "l", "source": "s", "term": b"a", "n": 2, "df": 1}
    assert divergence._combined([]).num_rows == 0
    words, at = divergence._words(pa.array([b"", b"ab", b"Cd 1e", b"", b"'"]))
    assert words.to_pylist() == [b"ab", b"cd", b"e"] and at.tolist() == [0, 0, 1, 3, 3, 3]


def test_dense_blocks_of_any_width_give_the_same_scores():
    rng = np.random.default_rng(2)
    terms = sorted({bytes(rng.integers(97, 123, 3).tolist()) for _ in range(60)})
    groups = ["a", "b", "c", "d"]
    entries = [(t, g, int(rng.integers(1, 9))) for t in terms for g in groups if rng.random() < 0.6]
    owners, sources, counts = zip(*entries)
    sizes = [sum(n for _, s, n in entries if s == g) for g in groups]
    given = (terms, list(owners), list(sources), list(counts), groups, sizes, len(terms))
    assert sorted(divergence.score_chunk(*given)) == sorted(divergence.score_chunk(*given, cells=4)) == sorted(divergence.score_chunk(*given, cells=29))


def test_large_counts_stay_exact():
    whole = 9 * 10**15
    for count in (1, 12_345_678_901, whole - 1, whole):
        assert divergence._parts_of(np.array([count]), np.array([whole]))[0] == 1 + 10**9 * count // whole


def test_a_task_holds_a_long_term_once():
    texts = pa.array([b"z" * 30_000] * 100)
    parts = divergence._slice_counts(["l"] * 100, [f"s{i}" for i in range(100)], texts)
    assert sum(b.num_rows for b in parts) == 100
    assert sum(b.nbytes for b in parts) < 2 * 30_000
    assert divergence._summed(parts * 3).nbytes < 2 * 30_000
    assert divergence._combined(parts * 3).to_pylist()[99] == {"lang": "l", "source": "s99", "term": b"z" * 30_000, "n": 3, "df": 3}


def test_small_chunks_give_the_plain_audit(spark, monkeypatch):
    docs = odd_docs()
    for name, value in (("CHUNK_TERMS", 2), ("CHUNK_ENTRIES", 5), ("CHUNK_BYTES", 9_000)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit(frame_of(spark, docs))) == plain(docs, 10)


def test_scoring_runs_one_chunk_at_a_time(spark):
    """One Python worker for each task, and groups, not whole partitions, go to it."""
    kept = spark.createDataFrame([("l", b"a", "s", 3, True), ("l", b"b", "s", 3, True)], "lang string, term binary, source string, n bigint, first boolean")
    langs = spark.createDataFrame([("l", ["s", "t"], [6, 0], 2, 2)], "lang string, groups array<string>, sizes array<bigint>, kept bigint, chunks bigint")
    plan = divergence.scores(kept, langs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert divergence.scores(kept, langs).where("part = 'pair'").groupBy("source", "item").sum("value").count() == 1


def test_long_terms_are_handed_on_before_they_fill_a_task():
    taken = []

    def batches():
        for i in range(1_200):
            taken.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(["l"]), pa.array(["s"]), pa.array([b"z" * 100_000 + "é".encode() * (i + 1)], pa.binary())], ["lang", "source", "text"])

    out = divergence.counted(batches())
    rows = [next(out)]
    assert len(taken) * 100_000 < 2 * divergence.COMBINED_BYTES
    rows += out
    assert sum(b.num_rows for b in rows) == 1_200 and max(b.nbytes for b in rows) < 1_200_000
    assert list(divergence._runs(np.array([3, 9, 1, 1, 1, 1]), 4, 3)) == [(0, 1), (1, 2), (2, 5), (5, 6)]
