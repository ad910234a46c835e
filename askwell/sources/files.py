"""Text files, one document per whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("value").alias("raw"),
        F.unix_micros("_metadata.file_modification_time").alias("modified"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source, raw, modified)`` for every file below ``path`` (glob or folder).

    A file that has vanished or can't be read to its end gives no row, and the others are read.
    """
    reader = spark.read.format("text").schema(FILE_SCHEMA).option("wholetext", True)
    tolerant = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return _named(tolerant.option("recursiveFileLookup", True).load(path))


def read_listed_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The same for some of the files below ``root``; the condition on paths leaves the others unopened."""
    files = read_files(spark, root)
    return files.where(F.col("source").isin(paths)).withColumn("source_file", F.col("source"))


def stream_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream of newly arriving files."""
    reader = spark.readStream.format("text").schema(FILE_SCHEMA).option("wholetext", True)
    reader = reader.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _named(reader.load(path))


def suffix_route(target: Column) -> Column:
    """``pdf`` goes to quarantine (no decoder here), everything else is text.

    The check is case-sensitive: ``A.PDF`` is read as text.
    """
    return F.when(target.endswith(".pdf"), "pdf").otherwise("text")


def universal_newlines(text: Column) -> Column:
    """Line ends as a text-mode reader gives them: always a single line feed."""
    has_returns = F.contains(text, F.lit("\r"))
    return F.when(has_returns, F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def reject_reason(source: Column, raw: Column) -> Column:
    """Why a file gives no documents; null if it is usable."""
    return F.when(suffix_route(source) == "pdf", F.lit("pdf")).when(
        ~F.is_valid_utf8(raw), F.lit("not utf-8")
    )


def file_documents(files: DataFrame) -> DataFrame:
    """Readable text files as ``(source, type, text)`` plus their other columns."""
    keep = [F.col(c) for c in files.columns if c not in ("source", "raw")]
    good = files.where(reject_reason(F.col("source"), F.col("raw")).isNull())
    return good.select(
        *keep,
        "source",
        F.lit("file").alias("type"),
        universal_newlines(F.col("raw")).alias("text"),
    )
