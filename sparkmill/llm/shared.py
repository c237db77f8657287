"""What several operators of this subpackage need: the shared scratch folder, words, and native text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.sources.scratch import shared_folder

#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


#: Tables that this process has written to the shared folder and not swept.
_written: list[str] = []


def write_table(df: DataFrame, tag: str) -> str:
    """Write df as a table in the shared folder; returns its path."""
    path = f"{shared_folder(df.sparkSession)}/mill-{uuid.uuid4().hex}-{tag}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back, so a lost executor costs no recomputation.

    few: df has a small, counted number of groups that are combined before their shuffle; one task writes them.
    """
    df = df.coalesce(1) if few else df
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, tag))


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _written:
        _written.remove(path)


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with a column i: their places 0, 1, ... in the given order; sorted by range, no task holds all rows."""
    held = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = held.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return held.join(F.broadcast(starts), part == F.col("part")).select(*rows.columns, (F.col("start") + place).alias("i"))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


#: Rows of a batch of texts that goes to a Python worker.
TEXT_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers by the thousand at most, not by ten thousands: whole texts are long."""
    now = int(spark.conf.get(BATCH_ROWS))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, the last one excepted; for narrow rows."""
    held: list[pa.RecordBatch] = []
    n = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this process has written to the shared folder, once no result needs them; returns how many."""
    n = len(_written)
    for path in [*_written]:
        delete_table(spark, path)
    return n


def written() -> list[str]:
    """The tables in the shared folder that sweep would delete."""
    return [*_written]
