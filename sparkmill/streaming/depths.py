"""Depth tables that arrive file by file: running totals by sample, as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def depth_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(file, name, depth) of every headerless depth table that is put into the folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    x = F.split("value", "\t")
    return lines.where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.get(x, F.lit(0)).alias("name"), F.get(x, F.lit(1)).cast("double").alias("depth"))


def sample_totals(stream: DataFrame) -> DataFrame:
    """(file, total, n_contigs): what scaling to a million needs; the state is a row a sample."""
    return stream.groupBy("file").agg(F.sum("depth").alias("total"), F.count(F.lit(1)).alias("n_contigs"))
