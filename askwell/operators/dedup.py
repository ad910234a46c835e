"""One row per distinct text, the last occurrence winning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import content_id


def with_content_id(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("chunk_id", content_id(F.col(content)))


def last_wins(df: DataFrame, order: list[str | Column], key: str = "chunk_id") -> DataFrame:
    """Keep, per ``key``, the row that is largest in ``order``.

    Partial aggregation leaves one row per key in every map task, so a text that
    makes up a third of the input sends no more rows than any other.
    """
    columns = [c for c in df.columns if c != key]
    winner = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(winner.alias("_w")).select(key, *(f"_w.{c}" for c in columns))
