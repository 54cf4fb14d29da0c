"""Secret scan in DataFrame functions alone.

Three fixed patterns give the base spans. Long tokens outside them are judged by
two character Markov models, one of random strings and one of ordinary
identifiers: a token is a secret when the mean log-likelihood ratio of its
character pairs reaches `THRESHOLD`. The models are pair counts over labelled
samples, kept as one array of thousandths of a nat, which is a constant of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in the order in which spans of one start are listed, and their patterns.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
MARKOV = "markov"
KINDS = [*PATTERNS, MARKOV]
ASSIGNED = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Mean thousandths of a nat for each pair of characters.
THRESHOLD = 600
#: Random strings to learn from, and labelled documents whose words are ordinary, at most.
RANDOM_ROWS, ORDINARY_ROWS = 4_000, 400
SMOOTHING = 0.5

# Ordinary identifiers, a labelled sample beside the words of documents.
IDENTIFIERS = """getElementById addEventListener document_root_path createDataFrame max_partition_bytes user_name first_name lastModifiedDate
content-type application/json text/html image/png x-request-id cache-control transfer-encoding getUserProfileById setDefaultTimeZone
customer_order_history is_valid_email_address parseInt toString hashCode equalsIgnoreCase StringBuilder ArrayIndexOutOfBoundsException
IllegalArgumentException NullPointerException ConcurrentModificationException org/apache/spark/sql/functions java/util/concurrent
src/main/resources/application usr/local/share/applications var/log/messages home/user/documents CamelCaseIdentifierExample
snake_case_identifier_example kebab-case-identifier-example SCREAMING_SNAKE_CASE_CONSTANT DEFAULT_BUFFER_SIZE MAX_RETRY_COUNT
page_number_of_results total_row_count http_status_code response_time_milliseconds created_at updated_at deleted_at
internationalization characteristically incomprehensibilities uncharacteristically responsibilities telecommunications
__init__ __main__ self_attention_layer learning_rate_scheduler batch_normalization gradient_accumulation_steps
en-us en-gb utf-8 iso-8859-1 2024-01-31 version-1 release-2024 build-number chapter-12 section-3 figure-7 table-of-contents
the-quick-brown-fox-jumps-over-the-lazy-dog lorem-ipsum-dolor-sit-amet all_your_base_are_belong_to_us read_write_permissions
================================ -------------------------------- ________________________________ ====----====----====""".split()


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<kind, start, end, value>>, in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["value"])
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    kinds = "array<struct<kind:int,start:int,end:int,value:string>>"
    none = F.array().cast(kinds)
    all_found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]).cast(kinds)
    return F.when(text.rlike(pattern), all_found).otherwise(none)


def samples(spark: SparkSession, docs: DataFrame, labels: DataFrame, random_rows: int = RANDOM_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """(token, label): hex, base64 and base36-like digests of a counter are random (1); identifiers and words of good documents are ordinary (0)."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    drawn = spark.range(random_rows).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)), F.base64(F.unhex(F.reverse(digest))), F.translate(F.base64(F.unhex(digest)), "+/", "-_"))).alias("token"),
        F.lit(1).alias("label"),
    )
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ordinary_rows)
    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(good), "doc_id")
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z_-]{3,}"), F.lit(0))).alias("token"), F.lit(0).alias("label"))
    listed = spark.range(20).select(F.explode(F.split(F.lit(" ".join(IDENTIFIERS)), " ")).alias("token"), F.lit(0).alias("label"))
    return drawn.unionByName(words).unionByName(listed)


def fit(labelled: DataFrame, smoothing: float = SMOOTHING) -> list[int]:
    """(token, label) -> log-likelihood ratio of each pair of ALPHABET's characters, in thousandths of a nat, row by row.

    Pairs with another character are not counted; a class without samples is uniform.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair")
    counted = labelled.where(F.length("token") > 1).select("label", pair).groupBy("label", "pair").agg(F.count("*").alias("n"))
    k = len(ALPHABET)
    counts = [[[smoothing] * k for _ in range(k)] for _ in range(2)]
    for row in counted.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect():  # the alphabet's pairs at most
        counts[row.label][ALPHABET.index(row.pair[0])][ALPHABET.index(row.pair[1])] += row.n
    logs = [[[math.log(v / sum(line)) for v in line] for line in one] for one in counts]
    return [round(1000 * (logs[1][a][b] - logs[0][a][b])) for a in range(k) for b in range(k)]


def _ratio(token: Column, model: list[int]) -> Column:
    """Mean thousandths of a nat over the token's pairs."""
    k = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda a, b: F.get(table, a * k + b))
    return F.aggregate(pairs, F.lit(0), lambda acc, v: acc + v) / F.size(pairs)


def scan(docs: DataFrame, model: list[int], threshold: int = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: `keep`, base and spans, both array<struct<kind, start, end, value>>.

    kind is a number in KINDS. Spans come by start, then kind; end is exclusive
    and both count code points. A token that touches a base span adds none. Null
    and empty texts have no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"_{kind}", _found(F.col("_text"), kind, pattern))
    rows = rows.withColumn("_assign", F.filter("_assign", lambda s: F.length(F.regexp_extract(s["value"], PATTERNS["assign"], 2)) >= ASSIGNED))
    rows = rows.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex"), _by_start))
    rows = rows.withColumn("_long", _found(F.col("_text"), MARKOV, CANDIDATE))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_added", F.filter("_long", lambda s: apart(s) & (_ratio(s["value"], model) >= threshold)))
    return rows.select(*keep, "base", F.array_sort(F.concat("base", "_added"), _by_start).alias("spans"))


def _by_start(a: Column, b: Column) -> Column:
    key = lambda s: s["start"] * F.lit(10) + s["kind"]
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by `mark`."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(inside)

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.struct(acc["at"].alias("at"), acc["out"].alias("out")))
    whole = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
