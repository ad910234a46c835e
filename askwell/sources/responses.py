"""Landed API responses: ``(url, status, body)`` rows to one document per leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.operators.flatten import all_leaves, is_readable

AUTH_STATUSES = (401, 403)
# Bodies that count as "nothing there" although a leaf could be read from them.
EMPTY_SCALAR = r"^\s*(?:false|-?0+(?:\.0+)?(?:[eE][+-]?\d+)?)\s*$"


def route(status: Column) -> Column:
    """``ok`` for 200, ``auth`` for refused credentials, ``error`` for the rest."""
    return (
        F.when(status == 200, "ok").when(status.isin(*AUTH_STATUSES), "auth").otherwise("error")
    )


def reject_reason(status: Column, body: Column) -> Column:
    """Why a response gives no documents; null if it is usable."""
    routed = route(status)
    return F.when(routed != "ok", routed).when(~is_readable(body), F.lit("unreadable"))


def leaf_documents(responses: DataFrame) -> DataFrame:
    """One ``(source, type, content)`` row per leaf of every usable response.

    Columns other than ``url``, ``status`` and ``body`` are kept. Leaves are not
    cut, however long they are, nor left out, however deep they lie.
    """
    keep = [c for c in responses.columns if c not in ("url", "status", "body")]
    usable = responses.where((F.col("status") == 200) & ~F.col("body").rlike(EMPTY_SCALAR))
    leaves = all_leaves(usable.select(*keep, "url", "body"), "body")
    return leaves.select(
        *keep,
        F.col("url").alias("source"),
        F.lit("json").alias("type"),
        "content",
    )
