"""Prefix trie of rebuilt conversations, merged family first.

A family is the conversations of one base id, conv_id - conv_id % 5. Each is
rebuilt from the base's first turns and its own later ones. Families stream
through sorted partitions; each builds the small trie of its own conversations,
and nodes carry a 128-bit digest of their whole path, so equal prefixes of
different families meet in one shuffle of nodes. A node of one family alone has
its whole subtree there, so that family's sums are final. Nodes of several
families are summed over the shared part of the trie by pointer doubling:
as many rounds as the logarithm of its depth.

A family's trie is handed on in parts when it grows past `part_nodes`; nodes that
are open at that point count as shared, so the result is the same and memory bounded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import drop_tables, materialize

FAMILY, PREFIXES = 5, 9
ROOT = bytes(16)
#: Nodes that a family's part holds in memory, at most.
PART_NODES = 100_000
#: Members' ids that one row of a chunk of ids holds.
CHUNK_IDS = 4_096
_NODES = "digest binary, parent binary, depth bigint, bytes bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, parts int, ends array<bigint>"
_ARROW = pa.schema(
    [("digest", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "bytes", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("parts", pa.int32()), ("ends", pa.list_(pa.int64()))]
)


class _Part:
    """The trie of some conversations of one family: digest -> [parent, depth, bytes, least id, members, children, end ids, parts]."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}

    def visit(self, digest: bytes, parent: bytes, depth: int, size: int, conv: int) -> None:
        node = self.nodes.get(digest)
        if node is None:
            self.nodes[digest] = [parent, depth, size, conv, 1, 0, [], 1]
            if depth and parent in self.nodes:
                self.nodes[parent][5] += 1
        else:
            node[3] = min(node[3], conv)
            node[4] += 1

    def rows(self) -> list[tuple]:
        """Nodes with the sums of their subtrees. A parent comes before its children, so the way back is bottom-up."""
        sums = {digest: [0, 0] for digest in self.nodes}
        out = []
        for digest, (parent, depth, size, conv, members, children, ends, parts) in reversed(self.nodes.items()):
            leaves, saved = sums[digest]
            leaves, saved = leaves or 1, saved + (members - 1) * size
            if depth and parent in sums:
                sums[parent][0] += leaves
                sums[parent][1] += saved
            above = self.nodes[parent][3] if depth and parent in self.nodes else None
            out.append((digest, parent if depth else None, depth, size, conv, above, members, children, leaves, saved, parts, ends))
        return out


def _next(parent: bytes, role: str, text: bytes) -> bytes:
    name = role.encode()
    return hashlib.blake2b(parent + struct.pack("<q", len(name)) + name + text, digest_size=16).digest()


class _Families:
    """Reads turns in the order of family, base first, conversation, turn; gives nodes of finished parts."""

    def __init__(self, part_nodes: int):
        self.part_nodes, self.part, self.family, self.conv = part_nodes, _Part(), None, None
        self.base: list[tuple[bytes, int]] = []  # path of the base's first turns: digest, bytes of the last text
        self.path: list[bytes] = []
        self.done: list[tuple] = []

    def _flush(self, open_path: list[bytes]) -> None:
        for digest in open_path:
            if digest in self.part.nodes:
                self.part.nodes[digest][7] = 2
        self.done += self.part.rows()
        self.part = _Part()

    def _enter(self, digest: bytes, size: int) -> None:
        self.part.visit(digest, self.path[-1] if self.path else ROOT, len(self.path), size, self.conv)
        self.path.append(digest)
        if len(self.part.nodes) >= self.part_nodes:
            self._flush(self.path)

    def _close(self) -> None:
        """The current conversation ends where its path does."""
        if self.conv is None:
            return
        last = self.path[-1]
        if last not in self.part.nodes:  # its part has been handed on: the same node again, without members
            self.part.nodes[last] = [self.path[-2] if len(self.path) > 1 else ROOT, len(self.path) - 1, self.sizes, self.conv, 0, 0, [], 2]
        self.part.nodes[last][6].append(self.conv)
        self.conv = None

    def finish(self) -> None:
        self._close()
        self._flush([])

    def turn(self, family: int, conv: int, role: str, text: bytes, shared: int) -> None:
        """One own turn; shared: how many turns this conversation takes of its base."""
        if family != self.family:
            self.finish()
            self.family, self.base = family, []
        if conv != self.conv:
            self._close()
            self.conv, self.path, self.seen = conv, [], 0
            self._enter(ROOT, 0)
            self.sizes = 0
            for digest, size in self.base[:shared] if conv != family else ():
                self._enter(digest, size)
                self.sizes = size
        self.seen += 1
        if conv == family and len(self.base) < PREFIXES - 1:
            self.base.append((_next(self.base[-1][0] if self.base else ROOT, role, text), len(text)))
        if conv == family or self.seen > shared:
            self.sizes = len(text)
            self._enter(_next(self.path[-1], role, text), len(text))


def family_nodes(conversations: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """(conv_id, turn, role, text) -> nodes of each family's trie, one row for each node and part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = _Families(part_nodes)
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                families.turn(*row)
                if len(families.done) >= 10_000:
                    yield _batch(families.done)
                    families.done = []
        families.finish()
        if families.done:
            yield _batch(families.done)

    conv = F.col("conv_id").cast("bigint")
    shared = F.crc32(conv.cast("string").cast("binary")) % PREFIXES
    turns = conversations.where("conv_id is not null").select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), shared.alias("shared"), F.col("turn")
    )
    ordered = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("family", "conv_id", "role", "text", "shared").mapInArrow(scan, _NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(digest, conv_id) -> digest, ends_sha256 of the ascending decimal ids, comma-joined.

    Ids are ordered over ranges, so a node at which very many conversations end is
    many tasks' work; these leave chunks of ids, which one task hashes in order as it reads them.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, ids = [], None, []
        for batch in batches:
            for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (d != digest or len(ids) >= CHUNK_IDS):
                    out.append((digest, ids[0], ",".join(map(str, ids))))
                    ids = []
                    if len(out) >= 1_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["digest", "first", "ids"])
                        out = []
                digest = d
                ids.append(i)
        if ids:
            out.append((digest, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = None, None
        for batch in batches:
            out = []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d != digest:
                    if state is not None:
                        out.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["digest", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    chunks = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(pack, "digest binary, first bigint, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """(digest, parent, depth, leaves, saved) -> digest, leaves, saved over each node's subtree.

    After round k a node holds the sums of its 2**k nearest levels and its ancestor 2**k levels up.
    """
    spark = shared.sparkSession
    state = materialize(shared.select("digest", F.when(F.col("depth") > 0, F.col("parent")).alias("above"), "leaves", "saved"), "trie-sums")
    depth = shared.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(depth).bit_length()):
        given = state.where("above is not null").groupBy(F.col("above").alias("digest")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        # Nothing is above the root, so rows that have reached it look nothing up.
        jump = state.where(F.col("above") != F.lit(ROOT)).select("digest", F.col("above").alias("key"))
        jumped = jump.join(state.select(F.col("digest").alias("key"), F.col("above").alias("next")), "key").select("digest", "next")
        grown = state.join(given, "digest", "left").join(jumped, "digest", "left")
        after = grown.select("digest", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        after = materialize(after, "trie-sums")
        drop_tables(spark, [state])
        state = after
    return state.select("digest", "leaves", "saved")


def prefix_trie(conversations: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, digest (of the path). Rows
    without a conv_id are left out; a null role or text is empty; turns of equal
    number are ordered by role, then text, and repeated rows are turns of their own.
    An empty table has no node. Very long conversations are handed on in parts.
    """
    spark = conversations.sparkSession
    families = materialize(family_nodes(conversations, part_nodes), "family-nodes")
    total = lambda c: F.sum(c).alias(c)
    merged = materialize(
        families.groupBy("digest", "parent", "depth", "bytes").agg(
            F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), total("n_convs"), total("parts"), total("n_children"), total("n_leaves"), total("saved_tokens")
        ),
        "merged-nodes",
    )
    alone, shared = merged.where("parts = 1"), merged.where("parts > 1")
    # What each node's children add: all count, those of one family bring their final sums.
    mine = F.col("parts") == 1
    below = merged.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(
        F.count("*").alias("children"), F.sum(F.when(mine, F.col("n_leaves")).otherwise(0)).alias("leaves"), F.sum(F.when(mine, F.col("saved_tokens")).otherwise(0)).alias("saved")
    )
    own = shared.join(below, "digest", "left").select(
        "digest", "parent", "depth", "conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
        F.when(F.col("children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    own = materialize(own, "shared-nodes")
    sums = _subtree_sums(own)
    columns = ["digest", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    common = own.drop("leaves", "saved").join(sums, "digest").withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    nodes = alone.select(*columns).unionByName(common.select(*columns))
    # The least member of a shared parent; that of another is known. The root is one row, and very many nodes' parent.
    top = merged.where("depth = 0").select(F.col("conv_id").alias("top_id"))
    above = own.where("depth > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("above_id"))
    deep = nodes.where("depth > 1").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("above_id", "parent_conv_id")).select(*columns)
    first = nodes.where("depth = 1").crossJoin(F.broadcast(top)).withColumn("parent_conv_id", F.col("top_id")).select(*columns)
    nodes = nodes.where("depth = 0").unionByName(first).unionByName(deep)
    hashes = member_hashes(families.select("digest", F.explode("ends").alias("conv_id")))
    ended = nodes.join(hashes, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    out = materialize(ended.drop("parent"), "trie")
    drop_tables(spark, [families, merged, own])
    return out
