"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition of an input too small to be split among all cores.

    CPU-heavy per-row work (regex folds, encoders) runs in the partitions it receives; a small file read as
    one split would use one core. The optimizer's size of the input decides: from one full split a core on, Spark's own
    splits serve and nothing is shuffled. Micro-batches are partitioned by their source.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df
