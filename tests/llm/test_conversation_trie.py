"""The prefix trie against a plain rebuild of every conversation."""

import hashlib
import random
import zlib

import pytest

from tamarack.llm import conversation_trie, queries
from tests import oracle

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, parent int"


def plain(rows):
    """One row for each prefix of a rebuilt conversation, by lists alone."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        rebuilt[c] = [t[2:] for t in own.get(c - rest, [])[:h] + own[c][h:]]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), sum(map(leaf, below)),
            sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()), key=str)


def conversations(rng, n, deepest=12):
    """Few different turns, so that prefixes meet within and across families; copies, ties, nulls, absent bases."""
    rows = []
    for c in rng.sample(range(-40, 400), n):
        size = rng.randrange(1, deepest)
        for k in range(size):
            turn = rng.choice([k, k, k, None, 0])
            rows.append((c, turn, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "a", "a", "é", "", None, "b" * 50])))
    rows += [(1_000 + i, k, "user", "same") for i in range(150) for k in range(3)]
    rows += [rows[0], (None, 0, "user", "lost"), (7_777, None, None, None), (8_888, 0, "user", "x" * 200_000), (8_890, 0, "user", "x" * 200_000)]
    return rows


@pytest.mark.parametrize("part_nodes", [100_000, 7])
def test_the_trie_is_the_plain_one(spark, part_nodes):
    rows = conversations(random.Random(part_nodes), 120)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert found(conversation_trie.prefix_trie(frame, part_nodes)) == plain(rows)


def test_one_long_conversation_in_parts_and_its_copies(spark):
    rows = [(c, k, "user", f"t{k % 7}") for c in (10, 15, 21) for k in range(120)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    for part_nodes in (100_000, 50):
        assert found(conversation_trie.prefix_trie(frame, part_nodes)) == plain(rows)


def test_one_family_and_none(spark):
    rows = [(5, 0, "user", "a"), (6, 0, "user", "b"), (7, 0, "user", "c")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert found(conversation_trie.prefix_trie(frame)) == plain(rows)
    assert conversation_trie.prefix_trie(frame.limit(0)).count() == 0


def test_many_members_of_one_node_are_hashed_in_order(spark):
    ids = list(range(20_000))
    frame = spark.createDataFrame([(b"n", i) for i in random.Random(3).sample(ids, len(ids))] + [(b"m", 4)], "digest binary, conv_id bigint")
    got = {bytes(r.digest): r.ends_sha256 for r in conversation_trie.member_hashes(frame).collect()}
    assert got == {b"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"m": hashlib.sha256(b"4").hexdigest()}


def test_the_query_agrees_with_its_sql(spark, tmp_path):
    rows = conversations(random.Random(5), 60, 6)
    path = f"{tmp_path}/a"
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    assert oracle.differences(queries.op11_prefix_trie(spark, path), queries.OP11_SQL, oracle.connect(path)) == ""
