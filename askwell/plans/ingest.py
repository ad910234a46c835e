"""Landed inputs to chunk rows: one plan for all source types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_texts
from askwell.operators.dedup import last_wins, with_content_id
from askwell.functions.text import has_http_scheme, is_safe_url
from askwell.operators.report import rejects
from askwell.sources.files import file_documents
from askwell.sources.files import reject_reason as file_problem
from askwell.sources.manifest import FILE_TYPE, URL_TYPES, bad_scheme, config_problem, missing_targets, source_manifest
from askwell.sources.pages import page_documents
from askwell.sources.responses import leaf_documents
from askwell.sources.responses import reject_reason as response_problem

# Where a chunk stood in the run: source, row of the source, chunk of the row.
POSITION = ("source_pos", "doc_pos", "chunk_no")
# Shares that the landed rows of one target are dealt in, so that a target with most of them is no hot key.
SALTS = 16
CHUNK_COLUMNS = ("chunk_id", "content", "source", "type", "start_index", *POSITION)


def listed(landed: DataFrame, manifest: DataFrame, kind: str, target: str) -> DataFrame:
    """Landed rows whose target the manifest lists under ``kind``, with its position.

    A target listed more than once counts at its last position. Every share of the landed rows
    meets its own copy of the manifest row. The copies are made after Spark has measured the manifest,
    so the join is told to shuffle both sides: a broadcast would bring them all to the driver.
    """
    wanted = (
        manifest.where(F.col("type") == kind)
        .groupBy(F.col("target").alias(target))
        .agg(F.max("source_pos").alias("source_pos"))
    )
    dealt = landed.withColumn("_share", F.pmod(F.xxhash64("doc_pos"), F.lit(SALTS)).cast("int"))
    copies = wanted.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies.hint("merge"), [target, "_share"]).drop("_share")


def page_chunks(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``pages``: url, html, source_pos, doc_pos."""
    return _chunk_rows(chunk_texts(page_documents(pages), "text", size, overlap))


def file_chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``files``: source, raw, source_pos, doc_pos."""
    return _chunk_rows(chunk_texts(file_documents(files), "text", size, overlap))


def leaf_chunks(responses: DataFrame) -> DataFrame:
    """``responses``: url, status, body, source_pos, doc_pos. Leaves are not cut.

    Leaves with equal text in one response differ in nothing, so they need no
    order of their own.
    """
    leaves = leaf_documents(responses)
    return _chunk_rows(
        leaves.withColumns(
            {"chunk_no": F.lit(0), "start_index": F.lit(None).cast("int")}
        )
    )


def _chunk_rows(df: DataFrame) -> DataFrame:
    return with_content_id(df).select(*CHUNK_COLUMNS)


def ingest(
    pages: DataFrame | None = None,
    responses: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Chunk rows of all inputs, repeated texts still in."""
    parts = []
    if pages is not None:
        parts.append(page_chunks(pages))
    if responses is not None:
        parts.append(leaf_chunks(responses))
    if files is not None:
        parts.append(file_chunks(files))
    if not parts:
        raise ValueError("nothing to ingest")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per text; the later source, row and chunk wins, at equal positions the larger source name."""
    return last_wins(chunks, [*POSITION, "source", "start_index"]).drop(*POSITION)


def ingest_manifest(
    configs: DataFrame, pages: DataFrame, responses: DataFrame, files: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Chunk rows of what the configurations list, and the rejects ``(source, type, reason)``.

    ``pages``: url, html, doc_pos; ``responses``: url, status, body, doc_pos; ``files``: source, raw,
    doc_pos. An unusable configuration lists nothing. Its rejects name the configuration, as do those
    of addresses that aren't http(s) and of files that haven't landed name the target.
    """
    marked = configs.withColumn("_problem", config_problem(configs))
    bad = marked.where("_problem IS NOT NULL").select(F.col("bot_name").alias("source"), F.lit("config").alias("type"), F.col("_problem").alias("reason"))
    wanted = source_manifest(marked.where("_problem IS NULL").drop("_problem"))
    schemes = bad_scheme(wanted).select(F.col("target").alias("source"), F.col("type").alias("type"), F.lit("bad scheme").alias("reason"))
    missing = missing_targets(wanted, files, "source").select(F.col("target").alias("source"), F.lit("file").alias("type"), F.lit("missing").alias("reason"))
    usable = wanted.where(~F.col("type").isin(*URL_TYPES) | has_http_scheme(F.col("target")))
    web = listed(pages, usable, "static_url", "url")
    api = listed(responses, usable, "dynamic_json", "url")
    texts = listed(files, usable, FILE_TYPE, "source")
    unsafe = F.when(~is_safe_url(F.col("url")), F.lit("unsafe host"))
    parts = [
        bad, schemes, missing,
        rejects(web, F.col("url"), "url", unsafe),
        rejects(api, F.col("url"), "json", response_problem(F.col("status"), F.col("body"))),
        rejects(texts, F.col("source"), "file", file_problem(F.col("source"), F.col("raw"))),
    ]
    turned_away = parts[0]
    for part in parts[1:]:
        turned_away = turned_away.unionByName(part)
    return ingest(web, api, texts), turned_away
