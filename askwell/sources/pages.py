"""Landed web pages: ``(url, html)`` rows to text and to blocks of text."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.functions.text import is_safe_url

# Tasks get this module's code with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BLOCK_WORDS = 10

# Elements that start a line of their own, and elements whose contents aren't text (fixed values).
BLOCK_TAGS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol br tr table article section nav header footer".split())
UNSEEN_TAGS = ("head", "script", "style")
_TAG = re.compile(r"<!--|<(/?)([a-z]\w*)[^>]*>|<[^>]*>", re.ASCII | re.IGNORECASE)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in UNSEEN_TAGS}
# Where text goes on after an element that is never closed.
_RESUME = re.compile(r"<(?:body|p|div|h[1-6]|ul|ol|table|article|section|nav|header|footer)\b", re.ASCII | re.IGNORECASE)
_EDGE = re.compile("[<>]")
BLANKS = r"[ \t\r\f\x0b\x{a0}]+"
# Character references (fixed values); the ampersand is decoded last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&amp;", "&"),
)


def visible_text(html: str) -> str:
    """The text outside tags, comments and unseen elements, a line feed for each block-level tag.

    One pass over the tags. A comment or an unseen element that is never closed hides the text up to the
    next tag that could end it, and no more: neither its contents nor the rest of the page go wrong.
    """
    out: list[str] = []
    at, last = 0, html.rfind(">") + 1  # beyond the last ">" nothing is a tag
    absent: set[str] = set()  # what is not found from here to the end

    def after(key: str, find: Callable[[], int]) -> int:
        end = -1 if key in absent else find()
        if end < 0:
            absent.add(key)
        return end

    while found := _TAG.search(html, at, last):
        out.append(html[at : found.start()])
        at = found.end()
        closing, name = found.group(1), (found.group(2) or "").lower()
        if found.group() == "<!--":
            end = after("-->", lambda: html.find("-->", at))
            if end >= 0:
                at = end + 3
            else:
                edge = _EDGE.search(html, at)
                at = len(html) if edge is None else edge.start() + (edge.group() == ">")
        elif name in _CLOSE and not closing:
            end = after(name, lambda: (m := _CLOSE[name].search(html, at)) and m.end() or -1)
            if end < 0:
                resume = _RESUME.search(html, at)
                end = len(html) if resume is None else resume.start()
            at = end
        elif name in BLOCK_TAGS:
            out.append("\n")
    out.append(html[at:].partition("<!--")[0])
    return "".join(out)


@F.pandas_udf(T.StringType())
def _visible(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text, na_action="ignore")


def page_lines(html: Column) -> Column:
    """Visible text with one line per block-level element, blanks collapsed."""
    text = _visible(html)
    for reference, char in ENTITIES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.regexp_replace(text, BLANKS, " ")


def page_blocks(html: Column, min_words: int = MIN_BLOCK_WORDS) -> Column:
    """``array<string>`` of the blocks that have at least ``min_words`` words."""
    lines = F.transform(F.split(page_lines(html), "\n"), lambda b: F.trim(b))
    return F.filter(lines, lambda b: F.size(F.split(b, " ")) >= min_words)


def page_text(html: Column, min_words: int = MIN_BLOCK_WORDS) -> Column:
    return F.array_join(page_blocks(html, min_words), "\n\n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def safe_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose address names a host that is not this machine."""
    return pages.where(is_safe_url(F.col(url)))


def page_documents(pages: DataFrame) -> DataFrame:
    """Safe, non-empty pages as ``(source, type, text)`` plus their other columns."""
    keep = [F.col(c) for c in pages.columns if c not in ("url", "html")]
    text = safe_pages(pages).select(
        *keep,
        F.col("url").alias("source"),
        F.lit("url").alias("type"),
        page_text(F.col("html")).alias("text"),
    )
    return text
