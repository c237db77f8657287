"""The folder that driver and executors share, and tables in it that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder of the session; a local folder is made only where neither is set and all runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkmill-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Tables that this process has written and not deleted.
_written: set[str] = set()


class Scratch:
    """The tables of one step of a computation; clear deletes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a table in the shared folder: its lineage is cut and a lost executor costs nothing."""
        path = f"{shared_folder(self.spark)}/mill-{uuid.uuid4().hex}"
        self.paths.append(path)
        _written.add(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            _delete(self.spark, self.paths.pop())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.discard(path)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder that stays until sweep."""
    return Scratch(df.sparkSession).keep(df)


#: Rows of a task, on average, where rows are dealt by their number.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt by keys to tasks of TASK_ROWS on average, of n in all; what goes by these keys after it needs no other shuffle.

    Adaptive execution joins partitions by their compressed bytes, and narrow rows take up to a hundred times that in memory; it leaves partitions of a
    given number alone. A key's rows go to one task, so what follows must combine them as they come, or hold few of a key.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with a column i: their places 0, 1, ... in the given order; sorted by range, no task holds all rows."""
    held = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("numbered_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("numbered_at", 33), F.col("numbered_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("numbered_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = held.groupBy(part.alias("numbered_part")).count().select("numbered_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("numbered_start"))
    return held.join(F.broadcast(starts), part == F.col("numbered_part")).select(*rows.columns, (F.col("numbered_start") + place).alias("i"))


def sweep(spark: SparkSession) -> int:
    """Delete what this process has stored, once no result needs it; returns how many tables."""
    paths = [*_written]
    for path in paths:
        _delete(spark, path)
    return len(paths)
