"""String expressions, all inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A Markdown table row, for multi-line search.
TABLE_ROW = r"(?m)^\s*\|.+\|\s*$"
NUMBER = r"\d+(\.\d+)?%?"
NUMERIC_TOKEN = r"(?U)(?<!\w)[-+]?[\d,.]+%?(?!\w)"
#: White space of any script, with the separators that Unicode counts as control characters.
SPACE = r"[\s\x1C-\x1F]"
#: Letters that have a lower case since Unicode 16.
LATER = "\u1c89\ua7cb\ua7cc\ua7da\ua7dc\U00010d50-\U00010d65"

# Boilerplate phrases, sought in a chunk's first 600 characters.
BOILERPLATE = (
    "(?s)免责声明|分析师声明|评级说明|风险提示.*本报告|版权所有.*禁止|执业编号|"
    "请务必阅读正文之后的免责|本报告仅供.*客户使用|证券投资咨询业务资格"
)
# A clear refusal, and a specific figure that makes it none.
ABSTENTION = (
    "(?i)(资料|参考资料|上下文|知识库|所给信息).{0,12}(不足|未提供|没有|无法|不能).{0,12}(确定|判断|回答|得出|查到)|"
    "无法根据.{0,20}(确定|判断|回答|得出)|信息不足"
)
SPECIFIC_NUMBER = r"(?U)(?<!\w)\d+(?:\.\d+)?\s*(?:%|万|亿|元|年|月|日|倍)"
# Signals of a market-research request.
RESEARCH_INTENTS = ("分析", "研究", "现状", "趋势", "展望", "格局", "规模", "供需", "驱动", "风险", "机会", "影响", "景气")
MARKET_SUBJECTS = ("行业", "市场", "产业", "赛道", "板块", "领域", "产业链", "市场规模", "竞争格局", "供给", "需求", "价格周期", "渗透率")
COMPANY_FINANCIALS = "(公司|股份|集团).{0,12}(财务|营收|收入|净利润|毛利率|估值)|(财务|营收|净利润|毛利率|估值).{0,12}(公司|股份|集团)"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lower_each(text: Column) -> Column:
    """Every letter lower-cased by itself to one letter, as SQL does by Unicode 15; `lower` looks around a sigma and makes two characters of a dotted I."""
    one = lambda c: F.when(c == "İ", "i").when(c.rlike(f"[{LATER}]"), c).otherwise(F.lower(c))
    return F.when(text.rlike(f"[Σİ{LATER}]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(F.lower(text))


def compact(text: Column, lower: Callable[[Column], Column] = F.lower) -> Column:
    """Without white space and commas, lower-cased."""
    return lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)[\s\x1C-\x1F,，]", ""))


def numbers(text: Column) -> Column:
    """Distinct numbers of the compact text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(compact(text), F.lit(NUMBER), F.lit(0)))


def unsupported_numbers(answer: Column, corpus: Column) -> Column:
    """Numbers of the answer that are no substring of the compact corpus."""
    return F.filter(numbers(answer), lambda n: ~F.contains(compact(corpus), n))


def normalise_source(path: Column) -> Column:
    """Trimmed, forward slashes, lower case, without leading ./ steps."""
    return F.regexp_replace(F.lower(F.replace(strip(path), F.lit("\\"), F.lit("/"))), r"^(\./)+", "")


def same_source(a: Column, b: Column) -> Column:
    """Equal, or one a path suffix of the other."""
    x, y = normalise_source(a), normalise_source(b)
    filled = (F.length(x) > 0) & (F.length(y) > 0)
    return filled & ((x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(normalise_source(path), "/"), -1)


def display_source(source_file: Column, chunk_id: Column, source_path: Column) -> Column:
    """The source file, else what precedes :: in the chunk id, else the path's last part."""
    prefix = F.when(F.contains(chunk_id, F.lit("::")), F.split_part(chunk_id, F.lit("::"), F.lit(1)))
    last = F.element_at(F.split(F.replace(source_path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.replace(F.coalesce(F.nullif(source_file, F.lit("")), F.nullif(prefix, F.lit("")), last), F.lit("\\"), F.lit("/"))


def trim_after(text: Column, n: int) -> Column:
    """At most n characters, then ... beyond them."""
    return F.when(F.length(text) > n, F.concat(rstrip(F.left(text, F.lit(n))), F.lit("..."))).otherwise(text)


def trim_within(text: Column, n: int, mark: str = "...") -> Column:
    """At most n characters, the mark among them."""
    return F.when(F.length(text) > n, F.concat(rstrip(F.left(text, F.lit(n - len(mark)))), F.lit(mark))).otherwise(text)


def query_hash(query: Column, lower: Callable[[Column], Column] = F.lower) -> Column:
    return F.sha2(lower(strip(query)), 256)


def case_id(chunk_ids: Column, question: Column) -> Column:
    return F.concat(F.lit("rag_"), F.substring(F.sha2(F.concat(F.array_join(chunk_ids, "|"), F.char(F.lit(0)), question), 256), 1, 16))


def key_digest(key: Column) -> Column:
    name = F.coalesce(F.nullif(strip(key), F.lit("")), F.lit("unknown"))
    return F.substring(F.sha2(name, 256), 1, 24)


def token_estimate(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 1) / 2).cast("long")


def is_noise(text: Column) -> Column:
    return F.substring(text, 1, 600).rlike(BOILERPLATE) | (F.length(strip(text)) < 100)


def has_table(text: Column, doc_type: Column | None = None) -> Column:
    found = text.rlike(TABLE_ROW)
    return found if doc_type is None else found | F.contains(F.lower(F.coalesce(doc_type, F.lit(""))), F.lit("table"))


def is_table_like(text: Column) -> Column:
    """Three lines or more, and 12 % of those with text, hold three numbers or more."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 0)
    dense = F.size(F.filter(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit(NUMERIC_TOKEN), F.lit(0))) >= 3))
    return (dense >= 3) & (dense / F.greatest(F.size(lines), F.lit(1)) >= 0.12)


def share_of(text: Column, letters: str) -> Column:
    """Share of characters in a character class; 0 for empty texts."""
    return F.coalesce(F.length(F.regexp_replace(text, f"[^{letters}]", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def cjk_share(text: Column) -> Column:
    return share_of(text, r"一-鿿")


def clear_abstention(answer: Column, refusal: str = ABSTENTION, figure: str = SPECIFIC_NUMBER) -> Column:
    """abstention, empty_response or judge_error of an answer whose judge failed."""
    text = strip(F.coalesce(answer, F.lit("")))
    short = (F.length(text) <= 180) & text.rlike(refusal) & ~text.rlike(figure)
    return F.when(F.length(text) == 0, "empty_response").when(short, "abstention").otherwise("judge_error")


def research_skill(text: Column) -> Column:
    """First intent and subject signal of a market-research request, else null."""
    plain = F.lower(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"(?U){SPACE}+", " "))
    first = lambda signals: F.get(F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(plain, s)), F.lit(0))
    intent, subject = first(RESEARCH_INTENTS), first(MARKET_SUBJECTS)
    chosen = intent.isNotNull() & subject.isNotNull() & ~plain.rlike(COMPANY_FINANCIALS)
    return F.when(chosen, F.concat(F.lit("research_intent="), intent, F.lit("; market_subject="), subject))


def strip_fence(text: Column) -> Column:
    """A Markdown code fence around the whole text is taken off."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


#: The sections of a document that :func:`markdown_document` takes.
SECTIONS = "array<struct<level:int,heading:string,content:string,bullets:array<string>,headers:array<string>,rows:array<array<string>>>>"


def markdown_cell(text: Column) -> Column:
    return strip(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", "<br>"))


def markdown_row(cells: Column, width: Column) -> Column:
    """Short rows padded, long rows cut."""
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return F.concat(F.lit("| "), F.array_join(F.transform(padded, markdown_cell), " | "), F.lit(" |"))


def table_markdown(cells: Column) -> Column:
    """array<array<string>>, the first the header, as a Markdown table: white space is one space, rows are padded or cut to the header; empty without one."""
    width = F.size(F.get(cells, F.lit(0)))
    clean = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", " "))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), clean), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    rows = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), row)
    return F.when(width > 0, F.array_join(F.concat(F.array(row(F.get(cells, F.lit(0))), rule), rows), "\n")).otherwise("")


def markdown_document(title: Column, facts: Column, sections: Column) -> Column:
    """A Markdown text of a title, facts (array<struct<name, value>>, may be null) and sections.

    sections: array<struct<level int, heading string, content string, bullets
    array<string>, headers array<string>, rows array<array<string>>>>; what is null or empty is left out,
    cells' pipes are escaped, short rows padded and long ones cut to the headers.
    """
    none = F.array().cast("array<string>")
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(s: Column) -> Column:
        width = F.size(s["headers"])
        fitted = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
        rows = F.transform(F.coalesce(s["rows"], F.array().cast("array<array<string>>")), lambda r: line(F.transform(fitted(r), cell)))
        head = F.array(line(F.transform(s["headers"], cell)), line(F.array_repeat(F.lit("---"), width)))
        return F.when(F.coalesce(width, F.lit(0)) > 0, F.concat(head, rows, F.array(F.lit("")))).otherwise(none)

    def lines(s: Column) -> Column:
        heading = F.when(F.coalesce(s["heading"], F.lit("")) != "", F.array(F.concat(F.repeat(F.lit("#"), F.coalesce(s["level"], F.lit(2))), F.lit(" "), s["heading"], F.lit("\n")))).otherwise(none)
        content = F.when(F.coalesce(s["content"], F.lit("")) != "", F.array(F.concat(s["content"], F.lit("\n")))).otherwise(none)
        bullets = F.when(F.coalesce(F.size(s["bullets"]), F.lit(0)) > 0, F.concat(F.transform(s["bullets"], lambda b: F.concat(F.lit("- "), F.coalesce(b, F.lit("")))), F.array(F.lit("")))).otherwise(none)
        return F.concat(heading, content, bullets, table(s))

    listed = F.transform(facts, lambda f: F.concat(F.lit("**"), f["name"], F.lit("**："), F.coalesce(f["value"], F.lit(""))))
    block = F.when(F.coalesce(F.size(facts), F.lit(0)) > 0, F.concat(F.array(F.lit("---")), listed, F.array(F.lit("---\n")))).otherwise(none)
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n"))), block, F.flatten(F.transform(F.coalesce(sections, F.array().cast(SECTIONS)), lines))), "\n")


def safe_name(text: Column, n: int = 40) -> Column:
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:*?"<>|\s]+', "_"), F.lit("_")), F.lit(n))


def row_text(names: list[str], headers: list[str] | None = None) -> Column:
    """header：value joined by ；, nulls and blanks left out; headers are the columns' names unless given."""
    parts = [F.when(F.length(strip(F.col(c).cast("string"))) > 0, F.concat(F.lit(f"{h}："), strip(F.col(c).cast("string")))) for c, h in zip(names, headers or names)]
    return F.array_join(F.filter(F.array(*parts), F.isnotnull), "；")


def nfkc_tokens(text: Column) -> Column:
    """Compatibility-normalised, case-folded words; runs of CJK as single characters and neighbouring pairs. Python, by Arrow batches."""
    return _nfkc(text)


# A valid search token, and ASCII expressions that stay whole beside their parts.
VALID_TOKEN = r"[\u3400-\u4dbf\u4e00-\u9fff]+|[a-z0-9]+(?:[._+/%\-][a-z0-9]+)*"
PROTECTED = r"(?<![a-z0-9])(?:[a-z0-9]+(?:[._+/%\-][a-z0-9]+)+|[a-z]+\d+[a-z0-9]*|\d+(?:\.\d+)?[a-z]+[a-z0-9]*)(?![a-z0-9])"


def _folded(value: str | None) -> list[str]:
    plain = unicodedata.normalize("NFKC", value or "").casefold()
    out: list[str] = []
    for word in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", plain):
        if "一" <= word[0] <= "鿿":
            out += [*word, *(a + b for a, b in zip(word, word[1:]))]
        else:
            out.append(word)
    return out


def _searched(value: str | None) -> list[str]:
    out = [w for w in _folded(value) if re.fullmatch(VALID_TOKEN, w)]
    known = set(out)
    for whole in re.findall(PROTECTED, unicodedata.normalize("NFKC", value or "").casefold()):
        if whole not in known:
            known.add(whole)
            out.append(whole)
    return out


def search_tokens(text: Column) -> Column:
    """`nfkc_tokens` of valid form, and whole expressions such as 2026h1 or 3.6tb/s besides. Python, by Arrow batches."""
    return _search(text)


#: Characters of texts whose words are Python objects at a time.
HELD_CHARS = 1_000_000


def _lists(texts: pa.Array, cut: Callable[[str | None], list[str]]) -> pa.Array:
    """A list of words for each text; a few texts at a time are Python objects, whatever the batch's size."""
    kind = pa.list_(pa.string())
    parts, held, room = [pa.array([], kind)], [], HELD_CHARS
    for value in texts:
        whole = value.as_py()
        held.append(cut(whole))
        room -= len(whole or "")
        if room <= 0:
            parts.append(pa.array(held, kind))
            held, room = [], HELD_CHARS
    return pa.concat_arrays([*parts, pa.array(held, kind)])


@F.arrow_udf(ArrayType(StringType()))
def _search(texts: pa.Array) -> pa.Array:
    return _lists(texts, _searched)


@F.arrow_udf(ArrayType(StringType()))
def _nfkc(texts: pa.Array) -> pa.Array:
    return _lists(texts, _folded)


def critical_sentences(text: Column, pattern: str, most: int = 500) -> Column:
    """Sentences that match, in order and once each; of a longer one the windows of `most` characters that match, with a mark where text is left out."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？；\n])"), strip), lambda s: F.length(s) > 0)

    def windows(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(s), F.lit(most))
        cut = lambda at: F.concat(F.when(at > 1, "…").otherwise(""), strip(F.substring(s, at, F.lit(most))), F.when(at + most <= F.length(s), "…").otherwise(""))
        return F.transform(F.filter(starts, lambda at: F.substring(s, at, F.lit(most)).rlike(pattern)), cut)

    kept = F.transform(sentences, lambda s: F.when(F.length(s) > most, windows(s)).when(s.rlike(pattern), F.array(s)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(kept))


def tool_protocol_leak(text: Column, marks: tuple[str, ...] = ("<tool_call", "<|tool", "<function=", "tool_calls")) -> Column:
    """Whether a model's text shows tool-call markup, white space aside."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(squeezed, m))


def progress_name(name: Column, n: int = 40) -> Column:
    """A tool's name for display: letters, digits, _ . - only."""
    return F.left(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_.-]", ""), F.lit(n))


def money(amount: Column, currency: str = "CNY") -> Column:
    """Six places under a hundredth, else four; a dash where there is no amount."""
    return F.when(amount.isNull(), "-").otherwise(F.concat(F.lit(f"{currency} "), F.when(F.abs(amount) < 0.01, F.format_number(amount, 6)).otherwise(F.format_number(amount, 4))))


def latency(seconds: Column) -> Column:
    """Milliseconds under a second, else seconds with two places; a dash where there is none."""
    short = F.concat(F.round(seconds * 1_000).cast("long").cast("string"), F.lit(" ms"))
    return F.when(seconds.isNull(), "-").when(seconds < 1, short).otherwise(F.concat(F.format_number(seconds, 2), F.lit(" s")))


def safe_sheet(name: Column) -> Column:
    """A sheet's name as part of an id: runs of other signs become _, none at either end; sheet if nothing is left."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\w.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"^_+|_+\z", ""), F.lit("")), F.lit("sheet"))


def fitting_prefix(text: Column, room: Column) -> Column:
    """The longest prefix whose JSON string, escapes counted and quotes not, has `room` characters or fewer."""
    escaped = F.regexp_replace(F.regexp_replace(text, r'(["\\\\\n\r\t\x08\x0C])', r"\\a"), r"[\x00-\x1F]", r"\\u0000")
    whole = F.regexp_replace(F.left(escaped, F.greatest(room, F.lit(0))), r"\\(u[0-9]{0,3})?\z", "")
    return F.left(text, F.length(F.regexp_replace(whole, r"\\(a|u0000)", "x")))
