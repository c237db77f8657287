"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: A table up to this size is dealt over the cores if it lies in fewer splits; a larger one is read as it is split.
DEALT_BYTES = 1 << 30


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table; a small one that lies in fewer splits than there are cores is dealt over them, as each split is read by one task.

    Dealing is the same in every run: rows are sorted before it.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= DEALT_BYTES and df.rdd.getNumPartitions() < cores else df
