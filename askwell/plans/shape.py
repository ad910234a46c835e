"""Small plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on inputs too small to fill them with whole file splits.

    One round-robin shuffle, and only if the optimizer's size estimate is below
    one full split per core; larger inputs are left as the scan cuts them.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(plan.stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * split else df
