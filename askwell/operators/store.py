"""A table of rows by key on plain parquet: insert or replace, never delete.

Every batch is written whole into a folder of its own, named by its place in time, its writer (a stream's
id, say) and its number with that writer, and a reader takes the latest row of each key. The checkpoint of
Structured Streaming decides which batches there are; here a batch that was written before is skipped, so
a replay changes nothing. A folder counts once Spark has marked it complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.session import delete

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("start_index", T.IntegerType()),
    ]
)
DEFAULT_WRITER = "main"
# The folder's own columns: place in time, and the batch.
_BATCH = T.StructType(
    [T.StructField("_at", T.LongType()), T.StructField("_writer", T.StringType()), T.StructField("_batch", T.LongType())]
)


class ChunkStore:
    """A folder of batches; ``schema`` may add columns such as a vector, or be one of other rows with a ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = CHUNK_SCHEMA, key: str = "chunk_id"):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def batches(self, own: str = "_writer=*/_batch=*", complete: bool = True) -> list[str]:
        """Folders of the batches that are there."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_at=*/{own}" + "/_SUCCESS" * complete)
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return sorted(f.getPath().toString().removesuffix("/_SUCCESS") for f in found)

    def holds(self, number: int, writer: str = DEFAULT_WRITER) -> bool:
        """Whether this batch was written before."""
        return bool(self.batches(f"_writer={writer}/_batch={number}"))

    def rows(self) -> DataFrame:
        """All rows of all batches, with the batch they came in."""
        schema = T.StructType([*self.schema, *_BATCH])
        folders = self.batches()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)

    def read(self) -> DataFrame:
        """The latest row of each key.

        A single batch has one row per key, and is read as it is. Of several, only keys are shuffled to
        find those that came in more than once; the rows themselves meet just these few, so they stay
        where the scan reads them while the few are small enough to broadcast by Spark's own measure.
        """
        if len(self.batches()) == 1:
            return self.rows().select(*self.schema.fieldNames())
        rows = self.rows().withColumn("_of", F.struct("_at", "_writer", "_batch"))
        seen = rows.groupBy(self.key).agg(F.max("_of").alias("_last"), F.min("_of").alias("_first"))
        again = seen.where(F.col("_first") != F.col("_last")).select(self.key, "_last")
        latest = rows.join(again, self.key, "left").where(F.col("_last").isNull() | (F.col("_of") == F.col("_last")))
        return latest.select(*self.schema.fieldNames())

    def upsert(self, batch: DataFrame, number: int, writer: str = DEFAULT_WRITER) -> bool:
        """Write batch ``number`` of ``writer``, one row per key. False if there was nothing to do.

        A batch without rows leaves nothing.
        """
        if not writer.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a writer's name is made of letters, digits, underscores and hyphens")
        if self.holds(number, writer):
            return False
        at = max((int(f.split("/_at=")[1].split("/")[0]) for f in self.batches(complete=False)), default=-1) + 1
        path = f"{self.root}/_at={at:012d}/_writer={writer}/_batch={number}"
        batch.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(path)
        if self.spark.read.schema(self.schema).parquet(path).head(1):
            return True
        delete(self.spark, path)
        return False


def replace_by_id(table: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Matched rows replaced, new ones added, unmentioned ones kept.

    Only the batch's ids meet the table: below the session's broadcast threshold
    the table is not shuffled, above it the join is an ordinary shuffled one.
    """
    kept = table.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.select(*table.columns))
