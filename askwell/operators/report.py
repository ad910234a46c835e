"""What a refresh took in and what it turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ingest_report(chunks: DataFrame) -> DataFrame:
    """Chunks per source before and after removing repeated texts.

    The distinct count is first grouped by id, so one large source is counted by
    many tasks.
    """
    return chunks.groupBy("source", "type").agg(
        F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("distinct_chunks")
    )


def rejects(rows: DataFrame, source: Column, kind: str, reason: Column) -> DataFrame:
    """The rows of one kind of input that give no documents, with the reason."""
    marked = rows.select(source.alias("source"), F.lit(kind).alias("type"), reason.alias("reason"))
    return marked.where(F.col("reason").isNotNull())


def reject_report(*parts: DataFrame) -> DataFrame:
    """Rejected inputs counted by type and reason."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("type", "reason").agg(F.count("*").alias("rejected"))
