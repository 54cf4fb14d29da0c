"""Dictionary terms as whole tokens beside a tokenizer's own: the longest match from left to right over a trie."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tamarack.functions.text import search_tokens

# Terms of the domain that a search takes whole.
DOMAIN_TERMS = """归母净利润 扣非净利润 营业收入 净资产收益率 毛利率 净利率 资本开支 经营性现金流 现金流量 市盈率 市净率 同比增长 环比增长 同比 环比 基点 点火价差 楼面价
公积金 晶圆代工 先进封装 先进制程 存储芯片 光刻机 覆铜板 外延片 台积电 英伟达 SK海力士 中芯国际 真武810E HBM4 NVLink WMCM""".split() + ["Vera Rubin"]
_END = ""


def normal(value: str | None) -> str:
    return unicodedata.normalize("NFKC", value or "").casefold()


def trie(terms: list[str]) -> dict:
    """Nested dictionaries by character; the empty key marks an end."""
    root: dict = {}
    for term in terms:
        node = root
        for c in normal(term).strip():
            node = node.setdefault(c, {})
        if node is not root:
            node[_END] = True
    return root


def found(text: str, root: dict) -> list[str]:
    """The longest term at each place, none inside another; an ASCII letter or digit at a term's edge must be its word's edge too."""
    word = lambda c: c.isascii() and c.isalnum()
    out, at, n = [], 0, len(text)
    while at < n:
        node, stop = root.get(text[at]), 0
        if node is not None and not (at and word(text[at]) and word(text[at - 1])):
            i = at + 1
            while True:
                if _END in node and not (i < n and word(text[i - 1]) and word(text[i])):
                    stop = i
                if i == n or text[i] not in node:
                    break
                node = node[text[i]]
                i += 1
        if stop:
            out.append(text[at:stop])
        at = stop or at + 1
    return out


def dictionary_terms(text: Column, terms: list[str]) -> Column:
    """Terms that occur in a text, each time they do, in order. Python, by Arrow batches; the dictionary goes along with the function."""
    root = trie(terms)

    def all_found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found(normal(t), root))

    all_found.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(all_found, ArrayType(StringType()))(text)


def with_terms(terms: list[str] = DOMAIN_TERMS, base: Callable[[Column], Column] = search_tokens) -> Callable[[Column], Column]:
    """A tokenizer of the base's tokens and the dictionary's terms; a term that the base finds itself in that text is not counted twice."""

    root = trie(terms)

    def added(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([[t for t in found(normal(text), root) if t not in known] for text, known in zip(texts, (set(o) if o is not None else set() for o in own))])

    added.__annotations__ = {"texts": pd.Series, "own": pd.Series, "return": pd.Series}
    more = F.pandas_udf(added, ArrayType(StringType()))

    def tokenizer(text: Column) -> Column:
        own = base(text)
        return F.concat(own, more(text, own))

    return tokenizer


def terms_version(terms: list[str] = DOMAIN_TERMS, base: str = "search") -> str:
    """A name for an index's fingerprint: it changes with the dictionary, not with its order or spelling of case and width."""
    listed = "\n".join(sorted({re.sub(r"\s+", " ", normal(t)).strip() for t in terms} - {""}))
    return f"{base};terms;{hashlib.sha256(listed.encode()).hexdigest()[:16]}"
