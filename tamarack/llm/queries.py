"""Thin queries over the operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import (
    chunk_dedup,
    conversation_trie,
    decontam,
    divergence,
    embedding_dedup,
    mixing,
    quality,
    quality_rules,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from tamarack.llm.common import drop_tables, held_out, materialize, shared_path, table


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, take away exact copies, revise counts of texts that a white-space clean-up changes, replay a batch.

    Of the rows of one text that of the least doc_id stays, null ids last; every
    row counts once on its way in. Copies go by signed sums alone: all rows
    are taken away and one of each text is put back, so no join meets a hot text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tidy = F.trim(F.regexp_replace(text, r"[\x20\t]+", " "))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), (tidy != text).alias("changed"),
        F.when(tidy != text, tidy).alias("tidy"),
    )
    facts = ["doc_id", "source", "lang", "digest", "changed"]
    counted = materialize(token_counts.count_tokens(docs, facts, texts={"text": "tokens", "tidy": "new_tokens"}), "tokens")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "source", "lang", "tokens", "changed", "new_tokens")
    kept = materialize(counted.groupBy("digest").agg(F.min(row).alias("row")).select("row.*"), "kept")
    revised = kept.where("changed").withColumnsRenamed({"tokens": "old_tokens", "new_tokens": "tokens"})
    rollup = token_counts.TokenRollup(spark, shared_path(spark, "token-rollup"))
    version = token_counts.VERSION
    copies = token_counts.deletes(counted, version).unionByName(token_counts.inserts(kept, version))
    rollup.commit("1-load", token_counts.inserts(counted, version))
    rollup.commit("2-copies", copies)
    rollup.commit("3-tidy", token_counts.revisions(revised, version))
    rollup.commit("2-copies", copies)
    totals = rollup.totals()
    drop_tables(spark, [counted, kept])
    return totals


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secret_scan.fit(secret_scan.samples(spark, docs, table(spark, sf_dir, "labels")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    return secret_scan.scan(docs, model).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secret_scan.PATTERNS),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("digest")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((('0x' || substr(h, 1 + CAST(5 * (i // 4) AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p JOIN f ON p.body = f.body
"""

OP6_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix|' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM w GROUP BY source),
k AS (SELECT *, number % 3 + 1 AS weight FROM s),
c AS (SELECT *, 3 * ss / weight AS ratio, sum(ss) OVER () AS full_size, sum(weight) OVER () AS full_weight,
    coalesce(sum(ss) OVER o, 0) AS held, coalesce(sum(weight) OVER o, 0) AS held_weight
  FROM k WINDOW o AS (ORDER BY 3 * ss / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((full_size - 3 * held) / (full_weight - held_weight), (ratio, number)) AS level FROM c WHERE full_size > 0 AND (full_size - 3 * held) / (full_weight - held_weight) <= ratio),
t AS (SELECT source, ss, number, least(coalesce(level, 0) * weight, 3.0 * ss)::DOUBLE AS target,
    CASE WHEN ss > 0 THEN CAST(ceil(ss / least(greatest(ceil(ss / 1024), 1024), ss)) AS BIGINT) END AS width FROM k, l),
p AS (SELECT *, CAST(ceil(ss / width) AS BIGINT) AS blocks FROM t),
u AS (SELECT *, coalesce(CAST(round(target * blocks / nullif(ss, 0) * 65536) AS BIGINT), 0) AS slots FROM p),
e AS (SELECT *, sum(slots) OVER (ORDER BY number)::BIGINT AS high, sum(slots) OVER ()::BIGINT AS total FROM u),
n AS (SELECT unnest(range(0, CAST(ceil(max(total) / 65536) AS BIGINT))) AS id, max(total) AS total FROM e),
x AS (SELECT id, ((((id % 1048576) * 0.6180339887498949::DOUBLE) % 1 + ((id // 1048576) * ((0.6180339887498949::DOUBLE * 1048576) % 1)) % 1) % 1) * total::DOUBLE AS x FROM n),
r AS (SELECT number, blocks, row_number() OVER (PARTITION BY number ORDER BY id) - 1 AS rank FROM x JOIN e ON x >= high - slots AND x < high),
b AS (SELECT number, rank % blocks AS block, count(*) AS times FROM r WHERE rank < blocks * 3 GROUP BY ALL),
d AS (SELECT w.*, t.ss, t.target, t.number, t.width, sum(size) OVER (PARTITION BY number ORDER BY h, doc_id, size, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
g AS (SELECT rid, number, width, upto - size AS a, upto AS z, unnest(range((upto - size) // width, (upto - 1) // width + 1)) AS block FROM d WHERE size > 0),
m AS (SELECT rid, sum((least(z, (g.block + 1) * width) - greatest(a, g.block * width)) * times)::BIGINT AS taken FROM g JOIN b ON g.number = b.number AND g.block = b.block GROUP BY rid)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0) AS taken FROM d LEFT JOIN m USING (rid)
"""

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
cuts AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
met AS (SELECT rid, cuts.n, i, item_id FROM cuts JOIN wins ON cuts.win = wins.win AND cuts.n = wins.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM met)) GROUP BY rid),
owned AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (rid) LEFT JOIN owned USING (rid)
"""

OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT crc.c, t.pos, t.role, t.body FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND t.pos <= h
  UNION ALL SELECT crc.c, t.pos, t.role, t.body FROM crc JOIN t ON t.c = crc.c AND t.pos > h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, sha256(strlen(role) || ':' || role || body) AS step, strlen(body) AS bytes FROM turns),
steps AS (SELECT c, d, string_agg(step, '') OVER (PARTITION BY c ORDER BY d) AS path, bytes FROM numbered UNION ALL SELECT c, 0, '', 0 FROM crc),
nodes AS (SELECT path, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(bytes) AS bytes FROM steps GROUP BY path),
named AS (SELECT n.*, CASE WHEN n.depth > 0 THEN substr(n.path, 1, 64 * (n.depth - 1)) END AS parent FROM nodes n),
kids AS (SELECT parent AS path, count(*) AS n_children FROM named WHERE parent IS NOT NULL GROUP BY parent),
whole AS (SELECT named.*, coalesce(n_children, 0) AS n_children FROM named LEFT JOIN kids USING (path)),
sums AS (SELECT up AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT substr(path, 1, 64 * unnest(range(0, depth + 1))) AS up, n_children, n_convs, bytes FROM whole) GROUP BY up),
ends AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM steps JOIN (SELECT c, max(d) AS d FROM steps GROUP BY c) USING (c, d) GROUP BY path)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM whole w JOIN sums s USING (path) LEFT JOIN ends e USING (path) LEFT JOIN nodes p ON p.path = w.parent
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT rid, lang, term FROM t) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (size + 2 * v) AS p
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (any_value(size) + 2 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(size) AS size FROM s GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM wins) WHERE times > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM again) GROUP BY rid),
m AS (SELECT d.rid, doc_id, stratum, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM d LEFT JOIN covered c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
grid AS (SELECT 'symbols' AS rule, unnest([2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03])::DOUBLE AS cutoff
  UNION ALL SELECT 'lines', unnest([0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05])::DOUBLE
  UNION ALL SELECT 'repeats', unnest([0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05])::DOUBLE
  UNION ALL SELECT 'long_words', unnest([40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0, 8.0, 7.0])::DOUBLE
  UNION ALL SELECT 'short_words', unnest([0.75, 0.5, 0.4, 0.35, 0.3, 0.27, 0.25])::DOUBLE),
long AS (SELECT rid, stratum, text, doc_id, base_failed, unnest(['symbols', 'lines', 'repeats', 'long_words', 'short_words']) AS rule,
    unnest([n_symbols / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0), word_chars / nullif(n_words, 0), n_words / nullif(word_chars, 0)]) AS value FROM b),
once AS (SELECT stratum, text, rule, any_value(value) AS value, min(quality) AS quality FROM long JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY stratum, text, rule),
tests AS (SELECT stratum, once.rule, cutoff, sum(quality)::BIGINT AS n, sum(CASE WHEN value > cutoff THEN quality ELSE 0 END)::BIGINT AS k, sum(CASE WHEN value > cutoff THEN 1 - quality ELSE 0 END) AS caught
  FROM once JOIN grid ON once.rule = grid.rule GROUP BY ALL),
tails AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.002) + (n - i) * ln(0.998))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tests WHERE k < n * 0.002) GROUP BY ALL),
held AS (SELECT tests.*, bool_and(coalesce(p <= 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM once)), false)) OVER (PARTITION BY tests.stratum, tests.rule ORDER BY tests.cutoff DESC) AS holds
  FROM tests LEFT JOIN tails ON tails.stratum = tests.stratum AND tails.rule = tests.rule AND tails.cutoff = tests.cutoff),
chosen AS (SELECT stratum, rule, arg_max(cutoff, (caught, cutoff)) AS cutoff FROM held WHERE holds AND caught > 0 GROUP BY stratum, rule),
bad AS (SELECT DISTINCT rid FROM long JOIN chosen USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM b LEFT JOIN bad USING (rid)
"""

QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_vp": op4_simhash_vp,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_cap_filters": op8_cap_filters,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_audit": op12_source_audit,
    "op13_quality_rules": op13_quality_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op2_warc": OP2_SQL, "op6_mixing": OP6_SQL, "op9_decontaminate": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_quality_rules": OP13_SQL}
