"""SimHash near-duplicates found through vantage-point trees.

Two 64-bit fingerprints that differ in at most `radius` bits differ in at most
radius // parts bits in one of their `parts` equal parts. So each part has a
vantage-point tree of its own, whose distances are those of that part: a
fingerprint lives in one leaf and also visits every leaf whose shell lies
within radius // parts of it by the triangle inequality. All links are found.
How many parts repeat the fewest rows is measured on a bounded sample, which
also gives the vantage points; below the levels that the sample can fit, all
nodes of a level share a seeded vantage point, so trees deepen with the table.
Every fingerprint is routed through the trees.

A leaf task compares its visitors with its members and returns a spanning
forest of what it found, made of links that it found, never all pairs. Leaves
with more rows than `block` are dealt out over a grid of block pairs, so no task
holds more than two blocks.

Where a least share of common shingles is asked for, texts whose numbers of
shingles are too different can't have it: every band of sizes has leaves of its
own, and a text visits its band's and the next one's. A small sketch drops
candidates that are far from that share; groups of candidates are then held
against their whole sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import drop_tables, materialize
from tamarack.llm.graph import connected_components

SEED = 42
#: Fingerprints to fit the trees on, at most, out of one in eight of all.
SAMPLE = 32_768
#: Sampled fingerprints that a fitted node needs.
FITTED = 32
#: Members that a leaf should have.
LEAF = 2_000
#: Rows on their way to leaves that are handed on together, but for the last leaf's.
ROUTED = 50_000
#: Rows of a leaf that one task holds twice at most.
BLOCK = 20_000
#: Bins of a sketch, a byte each.
BINS = 64
#: Rows of a group of candidates, with their shingles, that one task holds twice at most.
GROUP = 1_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text's word shingles.

    Only A-Z are lower-cased and only ASCII white space separates words. Null,
    empty and blank texts give zero; with fewer words than `width` the whole
    sequence is the one shingle.
    """
    return _majority(_hashes(text, width))


def _hashes(text: bytes | None, width: int) -> list[int]:
    words = (text or b"").lower().split()
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return [digest(join(words), SEED)]
    return [digest(join(t), SEED) for t in zip(*(words[i:] for i in range(width)))]


def _majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(octets), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp); fp holds the unsigned bits in a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"doc_id {kind}, fp bigint")


def sketch(grams: np.ndarray) -> bytes:
    """One byte for each of BINS ranges of the hash: of its least hash there, zero if it has none. `grams` is sorted."""
    bins = grams >> np.uint64(64 - int(math.log2(BINS)))
    first = np.flatnonzero(np.diff(bins.astype(np.int64), prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first].astype(np.int64)] = (grams[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def sketch_floor(least: float) -> int:
    """Equal bins that texts of that share have, four standard deviations less."""
    return math.ceil(BINS * least - 4 * math.sqrt(BINS * least * (1 - least)))


def text_prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) -> doc_id, fp, digest of the text, size (distinct shingles) and their sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, digests, sizes, sketches = [], [], [], []
            for text in batch.column(1):
                raw = text.as_py() or b""
                hashes = _hashes(raw, width)
                grams = np.unique(np.array(hashes, np.uint64))
                prints.append(_majority(hashes))
                digests.append(xxhash.xxh64_intdigest(raw, SEED))
                sizes.append(len(grams))
                sketches.append(sketch(grams))
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (prints, digests)]
            columns = [batch.column(0), *signed, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest", "size", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"doc_id {kind}, fp bigint, digest bigint, size int, sketch binary")


def _parts(prints: np.ndarray, parts: int) -> list[np.ndarray]:
    width = 64 // parts
    return [(prints >> np.uint64(width * i)) & np.uint64((1 << width) - 1) for i in range(parts)]


def _grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | None:
    """A fitted node (vantage, threshold, near, far), or None where the sample gives no more."""
    if depth and len(sample) >= FITTED:
        for vantage in rng.choice(sample, 4):
            far = np.bitwise_count(sample ^ vantage)
            cut = int(np.median(far))
            near = far < cut
            if 0.1 < near.mean() < 0.9:
                return (int(vantage), cut, _grow(sample[near], depth - 1, rng), _grow(sample[~near], depth - 1, rng))
    return None


class Forest:
    """A vantage-point tree for each of `parts` equal parts of the fingerprints."""

    def __init__(self, sample: np.ndarray, parts: int, radius: int, depth: int):
        self.parts, self.slack, self.width = parts, radius // parts, 64 // parts
        self.trees = [_grow(codes, depth, np.random.default_rng(7)) for codes in _parts(sample, parts)]

    def routes(self, prints: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(tree, leaf, rows that live in it or visit it, whether they live there), for leaves at `depth` at most."""
        for tree, codes in enumerate(_parts(prints, self.parts)):
            everyone = np.ones(len(prints), bool)
            for leaf, rows, home in self._descend(self.trees[tree], codes, np.arange(len(prints)), everyone, 1, 0, depth):
                yield tree, leaf, rows, home

    def _descend(self, node, codes, rows, home, number: int, level: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(rows):
            return
        if level == depth:
            yield number, rows, home
            return
        if node is None:  # a seeded vantage point for all nodes of the level
            drawn = int(np.random.default_rng([SEED, level]).integers(0, 1 << 64, dtype=np.uint64))
            vantage, cut, below = drawn % (1 << self.width), self.width // 2, (None, None)
        else:
            vantage, cut, below = node[0], node[1], node[2:]
        away = np.bitwise_count(codes[rows] ^ np.uint64(vantage)).astype(np.int64)
        to_near, to_far = away - self.slack < cut, away + self.slack >= cut
        yield from self._descend(below[0], codes, rows[to_near], home[to_near] & (away[to_near] < cut), 2 * number, level + 1, depth)
        yield from self._descend(below[1], codes, rows[to_far], home[to_far] & (away[to_far] >= cut), 2 * number + 1, level + 1, depth)

    def visits(self, sample: np.ndarray, depth: int) -> int:
        return sum(len(rows) for _, _, rows, _ in self.routes(sample, depth))


def _pairs(queries: np.ndarray, members: np.ndarray, q: np.ndarray, m: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a query, rows of members within radius); splits around a vantage point while both sides are large."""
    if len(q) * len(m) > 4_000_000 and len(m) > 512:
        vantage = members[m[len(m) // 2]]
        away = np.bitwise_count(members[m] ^ vantage).astype(np.int64)
        cut = int(np.median(away))
        near = away < cut
        if 0.1 < near.mean() < 0.9:
            reach = np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
            yield from _pairs(queries, members, q[reach - radius < cut], m[near], radius)
            yield from _pairs(queries, members, q[reach + radius >= cut], m[~near], radius)
            return
    step = max(1, 2_000_000 // max(1, len(m)))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        close = np.bitwise_count(queries[some][:, None] ^ members[m][None, :]) <= radius
        for k in np.flatnonzero(close.any(axis=1)):
            yield int(some[k]), m[np.flatnonzero(close[k])]


class _Groups:
    """Which rows are joined already; the largest group keeps its number, so a row is renumbered few times."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members: dict[int, list] = {}

    def join(self, names: list[int]) -> None:
        lists = [self.members.pop(name, [name]) for name in names]
        most = max(range(len(names)), key=lambda k: len(lists[k]))
        for k, some in enumerate(lists):
            if k != most:
                self.root[some] = names[most]
                lists[most].extend(some)
        self.members[names[most]] = lists[most]


def _likely(row: int, found: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, least: float) -> np.ndarray:
    """Rows of `found` that may share `least` of the row's shingles, the likeliest first."""
    found = found[np.minimum(sizes[found], sizes[row]) >= least * np.maximum(sizes[found], sizes[row])]
    equal = (sketches[found] == sketches[row]).sum(axis=1)
    order = np.argsort(-equal, kind="stable")
    return found[order[equal[order] >= sketch_floor(least)]]


def forest(prints: np.ndarray, home: np.ndarray, radius: int, likely=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows, rows) between all rows and the home rows, thinned to a spanning forest; `likely(row, found)` may drop some."""
    groups = _Groups(len(prints))
    rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, found in _pairs(prints, prints, np.arange(len(prints)), np.flatnonzero(home), radius):
        found = found[groups.root[found] != groups.root[row]]
        if likely is not None and len(found):
            found = likely(row, found)
        if len(found):
            roots, first = np.unique(groups.root[found], return_index=True)
            rows.append(np.full(len(roots), row))
            to.append(found[first])
            groups.join([int(groups.root[row]), *roots.tolist()])
    return np.concatenate(rows), np.concatenate(to)


def band(size, least: float):
    """Texts that share `least` of their shingles are in one band or in neighbouring ones; texts without any are apart."""
    width = math.log(1 / min(least, 0.99))
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / width + 1e-9)).otherwise(-2).cast("int")


def _dealt(rows: DataFrame, keys: list[str], mark: str, block: int) -> DataFrame:
    """With block numbers i <= j: rows of keys with more than `block` rows go to every cell of a grid that holds their own block."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = materialize(hot.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-groups")
    dealt = rows.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(mark), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def near_links(
    prints: DataFrame, radius: int = 3, parts: int | None = None, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK, least: float | None = None
) -> DataFrame:
    """(a, b): links that connect whatever lies within `radius` bits, one forest of links per leaf.

    `prints` holds distinct fp, which the links name. With `least` it holds rows
    (node, fp, size, sketch), whose nodes the links name, and only rows whose sizes
    and sketches let them share `least` of their shingles are linked. `parts` is
    the number of trees, by default the one of 1, 2 and 4 that repeats the fewest sampled rows.

    `prints` should be a written table: it is read for its count, the sample and the routing.
    """
    extra = [] if least is None else ["node", "size", "sketch"]
    prints = prints.select("fp", *extra, (F.lit(0) if least is None else band(F.col("size"), least)).alias("band"))
    totals = {r.band: r.n for r in prints.groupBy("band").agg(F.count("*").alias("n")).collect()}  # some 80 bands at most
    depths = {b: max(0, math.ceil(math.log2(n / leaf))) for b, n in totals.items()}
    depth = max(depths.values(), default=0)
    chosen = prints.where(F.pmod(F.xxhash64(F.lit("tree"), "fp"), F.lit(8)) == 0).orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp")
    seeds = np.array([r.fp for r in chosen.collect()] if depth else [], dtype=np.int64).view(np.uint64)
    made = [Forest(seeds, p, radius, depth) for p in ((parts,) if parts else (1, 2, 4) if depth else (1,))]
    trees = min(made, key=lambda f: f.visits(seeds[:4_096], depth)) if len(made) > 1 else made[0]

    names = ["band", "tree", "leaf", "home", "fp", *extra]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bands = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(batch.num_columns - 1))
            held, n = [], 0
            for own in np.unique(bands):
                rows = np.flatnonzero(bands == own)
                for to in (own,) if least is None else (own, own + 1):
                    for tree, number, some, home in trees.routes(codes[rows], depths[to]) if to in depths else ():
                        held.append((to, tree, number, rows[some], home & (to == own)))
                        n += len(some)
                        if n >= ROUTED:
                            yield placed(batch, held)
                            held, n = [], 0
            if held:
                yield placed(batch, held)

    def placed(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        """One batch for the rows of many leaves."""
        bands, numbers, leaves, rows, homes = zip(*held)
        counts = [len(some) for some in rows]
        place = [np.repeat(np.array(v, k), counts) for v, k in ((bands, np.int32), (numbers, np.int32), (leaves, np.int64))]
        taken = pa.array(np.concatenate(rows))
        columns = [*map(pa.array, place), pa.array(np.concatenate(homes)), *(batch.column(k).take(taken) for k in range(batch.num_columns - 1))]
        return pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"{c} {prints.schema[c].dataType.simpleString()}" for c in ("fp", *extra))
    routed = prints.mapInArrow(route, f"band int, tree int, leaf bigint, home boolean, {kinds}")
    keys = ["band", "tree", "leaf"]
    cells = _dealt(routed, keys, extra[0] if extra else "fp", block).drop("own")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        codes, home = cell.column("fp").to_numpy().view(np.uint64), cell.column("home").to_numpy()
        names, likely = cell.column(extra[0] if extra else "fp").to_numpy(), None
        if least is not None:
            sizes, sketches = cell.column("size").to_numpy(), np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            likely = lambda row, found: _likely(row, found, sizes, sketches, least)
        rows, to = forest(codes, home.astype(bool), radius, likely)
        yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(names[to])], ["a", "b"])

    return cells.groupBy(*keys, "i", "j").applyInArrow(link, "a bigint, b bigint")


def shingles(text: bytes | None, width: int) -> set[bytes]:
    """Distinct word shingles, by the fingerprint's rules."""
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def shared_links(docs: DataFrame, texts: DataFrame, radius: int, width: int, least: float, group: int = GROUP) -> DataFrame:
    """Links (a, b) within groups of candidates whose texts share `least` or more of their distinct shingles.

    texts (tree, node, fp, size, sketch, digest, first_id) names a document of each
    text and its group. Their whole texts are read again, once, and become sets of
    shingle hashes. Every two rows of a group that are within the radius and whose
    sketches allow it are compared, unless links found before join them already;
    what is returned connects all that is alike. Groups of more than `group`
    rows are dealt over a grid of block pairs.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    met = found.join(texts, (found["digest"] == texts["digest"]) & found["doc_id"].eqNullSafe(texts["first_id"]))
    columns = ["tree", "node", "fp", "size", "sketch"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(_hashes(t.as_py(), width), np.uint64)).tobytes() for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], [*columns, "grams"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)
    rows = met.select(*(texts[c] for c in columns), F.col("text").cast("binary").alias("text")).mapInArrow(cut, f"{kinds}, grams binary")
    rows = materialize(rows, "candidate-texts")
    cells = _dealt(rows, ["tree"], "node", group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        codes, nodes, sizes, own = (cell.column(c).to_numpy() for c in ("fp", "node", "size", "own"))
        sketches = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        grams, prints = cell.column("grams"), codes.view(np.uint64)
        lower = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
        groups, a, b = _Groups(len(nodes)), [], []
        sets: dict[int, np.ndarray] = {}

        def of(row: int) -> np.ndarray:
            if row not in sets:
                if len(sets) > 1_000:
                    sets.clear()
                sets[row] = np.frombuffer(grams[row].as_py(), np.uint64)
            return sets[row]

        for row, near in _pairs(prints, prints, np.arange(len(nodes)), np.arange(len(nodes)), radius):
            near = near[(groups.root[near] != groups.root[row]) & ((near < row) if lower else (own[near] < own[row]))]
            for other in _likely(row, near, sizes, sketches, least) if len(near) else ():
                if groups.root[other] != groups.root[row]:
                    common = len(np.intersect1d(of(row), of(other), assume_unique=True))
                    if common >= least * (sizes[row] + sizes[other] - common):
                        groups.join([int(groups.root[row]), int(groups.root[other])])
                        a.append(nodes[row])
                        b.append(nodes[other])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.groupBy("tree", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, radius: int = 3, width: int = 3, parts: int | None = None, least: float | None = None, leaf: int = LEAF, block: int = BLOCK
) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id.

    component_id is the least doc_id reachable over links of at most `radius`
    differing bits, texts without words (fingerprint zero) included. With `least`,
    a link also needs that share of common shingles; all such links count, and only
    equal texts are one from the start. Null ids
    keep their rows and are never a component's id unless it has no other.
    Repeated rows each give a row; columns other than doc_id and text are ignored.
    """
    spare = []
    if least is None:
        keys = ["fp"]
        rows = materialize(fingerprints(docs, width), "fingerprints")
        firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.col("fp")), "prints")
        links = near_links(firsts.select("fp"), radius, parts, leaf=leaf, block=block)
    else:
        keys = ["fp", "digest", "size"]
        rows = materialize(text_prints(docs, width), "fingerprints")
        firsts = rows.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"))
        firsts = materialize(firsts.withColumn("node", F.monotonically_increasing_id()), "texts")
        links, spare = alike_links(docs.select("doc_id", "text"), firsts, radius, width, parts, least, leaf, block)
    roots = connected_components(links)
    drop_tables(docs.sparkSession, spare)
    placed = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = placed.join(lowest, "root").select(*keys, "component_id")
    return rows.join(of_print, keys).select("doc_id", "fp", "component_id")


def alike_links(
    docs: DataFrame, texts: DataFrame, radius: int, width: int, parts: int | None, least: float, leaf: int = LEAF, block: int = BLOCK
) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) of nodes that connect all texts within `radius` bits that share `least` of their shingles, and a table to drop after use."""
    near = near_links(texts.select("fp", "node", "size", "sketch"), radius, parts, leaf=leaf, block=block, least=least)
    trees = connected_components(near).withColumnRenamed("root", "tree")
    grouped = texts.select("fp", "node", "size", "sketch", "digest", "first_id").join(trees, "node")
    links = materialize(shared_links(docs, grouped, radius, width, least), "alike")
    return links, [links]


def hex_fingerprint(column="fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
