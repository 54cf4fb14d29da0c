"""Every registered query against its SQL, over whole small tables."""

from pathlib import Path

import numpy as np
import pytest

from tamarack.plans import catalogue
from tests import oracle

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_its_sql(spark, con, name):
    assert oracle.differences(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLES[name], con) == ""


def test_queries_without_sql_are_the_known_ones():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"semantic_dedup_keep", "split_text", "nfkc_tokens"}
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_greedy_keep_is_the_sequential_one(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    units = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    kept = []
    for i in units:
        if all(units[i] @ units[j] < 0.5 for j in kept):
            kept.append(i)
    got = {r.vec_id for r in catalogue.QUERIES["semantic_dedup_keep"](spark, SMALL).where("kept").collect()}
    assert got == set(kept)


def test_split_covers_every_text(spark):
    sizes = {}
    for r in catalogue.QUERIES["split_text"](spark, SMALL).collect():
        key, _, seq = r.chunk_id.partition("::basic_")
        assert 0 < r.chars <= 500
        sizes.setdefault(int(key), []).append(int(seq))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert set(sizes) == {i for i, t in texts.items() if t and t.strip()}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
