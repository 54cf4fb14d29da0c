"""Quality rules whose cutoffs are certified on labelled rows, in DataFrame functions alone.

Fixed rules fail texts of few words or of many repeated windows. Beyond these,
five measured rules may reject a text. Each has a fixed grid of cutoffs from lenient
to strict; in each stratum (language) a cutoff is certified while the exact binomial
tail P(Bin(n, risk) <= rejected) over the n good labelled texts stays under
level / (rules x strata). Cutoffs of one rule and stratum are tested in their order,
up to the first that fails, so all certified ones hold together with confidence
1 - level, and all rules together reject at most RISK of a stratum's good texts.
Of the certified cutoffs that one is taken which rejects the most bad labelled
texts, the most lenient of equals; a rule that rejects none is off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import drop_tables, materialize

# White space between words, and symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Good texts of a stratum that all rules together may reject, and the chance that any stratum's bound fails.
RISK, LEVEL = 0.01, 0.05
#: Rule: what it divides by what, and its cutoffs from lenient to strict. A text above the cutoff is rejected; `short_words` is 1 / length.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "n_words", [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03]),
    "lines": ("n_dup_lines", "n_lines", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "repeats": ("n_repeat_words", "n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars", "n_words", [40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0, 8.0, 7.0]),
    "short_words": ("n_words", "word_chars", [0.75, 0.5, 0.4, 0.35, 0.3, 0.27, 0.25]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, though used many times."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column, make) -> Column:
    """make(first, second, third, place) for each three words in a row."""
    places = F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), i))


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted by text, neighbours compared, places of the equal ones put together."""
    windows = F.sort_array(_windows(words, lambda a, b, c, i: F.struct(F.concat_ws(" ", a, b, c).alias("w"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def cover(acc: Column, i: Column) -> Column:
        return F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))

    return F.aggregate(_let(windows, places), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda acc: acc["n"])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, MEASURES (long) and mark (a hash of the text) of each whole text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.select(
        *keep, "_words", F.xxhash64("_text").alias("mark"), F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), _windows(F.col("_words"), lambda a, b, c, i: F.xxhash64(a, b, c)).alias("_hashes"),
    )
    # Different windows may share a hash, equal ones always do: without a repeated hash there is no repeat.
    repeats = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeated_words(F.col("_words"))).otherwise(0)
    return rows.select(
        *keep, "mark", "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _value(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.col(over) / F.nullif(F.col(under), F.lit(0))


def log_tail(rejected: Column, n: Column, risk: float) -> Column:
    """Logarithm of P(Bin(n, risk) <= rejected), exact but for rounding; 0 where `rejected` is the mean or more."""
    none = n * math.log1p(-risk)
    start = F.struct(none.alias("term"), none.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + math.log(risk / (1 - risk))
        most = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (most + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), rejected), start, add, lambda acc: acc["total"])
    return F.when(rejected >= n * risk, 0.0).when(rejected == 0, none).otherwise(some)


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff: the chosen certified cutoffs.

    `measured` is a written table of doc_id, stratum and what :func:`measure` gives (its
    long expressions would else be worked out once for each use). Labelled texts that the
    fixed rules fail are left out; copies of one text in a stratum count once, bad if
    any is; of two labels of an id the lower holds. No bound is put on labelled rows: they are counted, not collected.
    """
    spark = measured.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    passed = F.array(*(F.struct(F.lit(r).alias("rule"), sum((F.coalesce(_value(r) > c, F.lit(False))).cast("int") for c in RULES[r][2]).alias("passed")) for r in RULES))
    labelled = measured.where(~base_failed()).join(known, "doc_id").select("stratum", "mark", "quality", passed.alias("rules"))
    once = labelled.groupBy("stratum", "mark").agg(F.min(F.struct("quality", "rules")).alias("row")).select("stratum", "row.*")
    hits = once.select("stratum", "quality", F.explode("rules").alias("hit")).groupBy("stratum", "hit.rule", "hit.passed")
    counts = materialize(hits.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")), "rule-counts")
    strata = max(1, counts.select("stratum").distinct().count())
    # A value passes cutoff k, counted from the lenient end, if it passes all but k of them.
    grid = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("place"), F.lit(c).alias("cutoff"), F.lit(len(RULES[r][2]) - k).alias("least")) for r in RULES for k, c in enumerate(RULES[r][2]))))
    cutoffs = spark.range(1).select(grid.alias("g")).select("g.*")
    hit = F.col("passed") >= F.col("least")
    tests = counts.join(cutoffs, "rule").groupBy("stratum", "rule", "place", "cutoff").agg(
        F.sum("good").alias("n"), F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("rejected"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("caught")
    )
    allowed = math.log(level / (len(RULES) * strata))
    holds = F.min(log_tail(F.col("rejected"), F.col("n"), risk / len(RULES)) <= allowed).over(Window.partitionBy("stratum", "rule").orderBy("place"))
    chosen = tests.withColumn("holds", holds).where("holds and caught > 0").groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("caught", -F.col("place"))).alias("cutoff"))
    chosen = materialize(chosen, "rule-cutoffs")
    drop_tables(spark, [counts])
    return chosen


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`measured` with base_failed and kept: false where the fixed rules fail or a value passes its stratum's cutoff."""
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES))
    within = F.lit(True)
    for rule in RULES:
        within &= F.coalesce(_value(rule) <= F.col(f"_{rule}"), F.lit(True))
    judged = measured.join(wide, "stratum", "left").withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & within).drop(*(f"_{r}" for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept of every document; strata are languages, a null one being ''.

    Repeated rows are judged alike and stay. An empty table gives none; without labels, or with too
    few for any certificate, only the fixed rules reject.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")
    measured = materialize(measure(rows, ["doc_id", "stratum"]), "measures")
    out = judge(measured, certify(measured, labels, risk, level))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")
