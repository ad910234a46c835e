"""Which files are new or have changed, from listings that read no content."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEN_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("modified", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
# Files whose paths a run holds at a time.
SLICE_FILES = 10_000


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(source, modified, length)`` of every file below ``root``; the files aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.col("_metadata.file_path").alias("source"),
        F.unix_micros("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("length"),
    )


def changed(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files of the listing that weren't seen with this time and length."""
    return listing.join(seen, ["source", "modified", "length"], "left_anti")


def slices(files: DataFrame, most: int | None = None) -> Iterator[DataFrame]:
    """The listing in parts of about ``most`` files."""
    count = -(-files.count() // (most or SLICE_FILES))
    for i in range(count):
        yield files.where(F.pmod(F.xxhash64("source"), F.lit(count)) == i)


def unread(listing: DataFrame, read: DataFrame) -> DataFrame:
    """Rejects ``(source, type, reason)``: listed files of which nothing was read."""
    lost = listing.join(read.select("source").distinct(), "source", "left_anti")
    return lost.select("source", F.lit("file").alias("type"), F.lit("unreadable").alias("reason"))
