"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip removes; every such character lies below U+3001.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Control characters removed from questions, and the characters kept (fixed values).
CONTROL_CLASS = r"[\x00-\x1f\x7f]"
QUESTION_LIMIT = 1000

# Hosts a page may not be fetched from (fixed values).
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")


def sql_let(name: str, value: str, body: str) -> str:
    """Bind ``value`` once so that ``body`` can use it several times, as SQL text.

    Inside a lambda Spark has no common-subexpression elimination; a
    one-element ``transform`` is the cheapest way to name an intermediate.
    Large expressions are composed as text, which is parsed in one go; built from
    Column calls they would cost seconds of driver round trips per query.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def quoted(column: str) -> str:
    """A column name as SQL text."""
    return "`" + column.replace("`", "``") + "`"


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def clean_question(col: Column) -> Column:
    """Cut to 1000 characters, delete control characters, then strip."""
    cut = F.substring(col, 1, QUESTION_LIMIT)
    return strip(F.regexp_replace(cut, CONTROL_CLASS, ""))


def content_id(col: Column) -> Column:
    """Identity of a chunk: md5 of its text and nothing else."""
    return F.md5(col)


# Scheme, then the authority up to a path, query or fragment.
AUTHORITY = r"^[a-z][a-z0-9+.\-]*://([^/?#]*)"


def url_host(col: Column) -> Column:
    """Lower-case host without user, port or IPv6 brackets; null if there is none.

    Taken from the text alone, so that hosts and addresses a strict parser refuses (underscores,
    spaces, letters beyond ASCII) are kept.
    """
    authority = F.regexp_extract(F.lower(col), AUTHORITY, 1)
    host = F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:\[\]]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^\[|\]$", ""), F.lit(""))


def is_safe_url(col: Column) -> Column:
    # No host counts as local, so that the address is parsed once.
    return ~F.coalesce(url_host(col), F.lit("")).isin("", *LOCAL_HOSTS)


def has_http_scheme(col: Column) -> Column:
    return col.startswith("http://") | col.startswith("https://")
