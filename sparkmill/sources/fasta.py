"""FASTA files: splittable reading by records, reading of any compression by content, and writing of bins."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions.sequences import clean_sequence, description, fasta_record, identifier, is_nucleotides

#: First bytes of compressed files (fixed values).
MAGIC = ((b"\x1f\x8b", gzip.decompress), (b"BZ", bz2.decompress), (b"\xfd7zXZ\x00", lzma.decompress))


def decompressed(data: bytes) -> bytes:
    """The content of a gzip, bzip2, xz or plain file, told apart by its first bytes."""
    for start, unpack in MAGIC:
        if data.startswith(start):
            return unpack(data)
    return data


def _fault(condition, text, value):
    return F.when(condition, F.raise_error(F.concat(F.lit(text), F.coalesce(value, F.lit("")))).cast("string"))


def _records(rows: DataFrame) -> DataFrame:
    """rows (file, place, record): a record is what stands between two line starts with `>`."""
    text = F.regexp_replace(F.regexp_replace("record", r"^>", ""), r"\r", "")
    header = F.regexp_extract(text, r"^([^\n]*)", 1)
    seq = clean_sequence(F.regexp_replace(text, r"^[^\n]*\n?", ""))
    parsed = rows.select("file", "place", header.alias("header"), seq.alias("s"))
    name = _fault(identifier(F.col("header")).isNull(), "not a sequence identifier: ", F.col("header")).otherwise(identifier(F.col("header")))
    sequence = _fault(~is_nucleotides(F.col("s")), "not a nucleotide sequence: ", F.col("header")).otherwise(F.col("s"))
    return parsed.select("file", "place", name.alias("name"), description(F.col("header")).alias("description"), sequence.alias("seq"), F.length("s").alias("length"))


def read_fasta(spark: SparkSession, path: str | list[str], sniff: bool = False) -> DataFrame:
    """(file, place, name, description, seq, length) of all records; (file, place) is their order.

    The text is split at line starts with `>`, so that large plain files are read in parallel and .gz and .bz2 are known by
    their names. sniff: compression is told by content, xz too, with a file as the unit. Invalid identifiers and
    letters are errors; so is text before the first `>`, an empty file has no records.
    """
    paths = [path] if isinstance(path, str) else path
    if sniff:
        files = spark.read.format("binaryFile").load(paths).select("path", "content")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                    text = decompressed(content.as_py()).decode()
                    if text.strip() and not text.startswith(">"):
                        raise ValueError(f"{name} does not start with >")
                    parts = [p for p in ("\n" + text).split("\n>")[1:]]
                    for k in range(0, len(parts), 1000):
                        part = parts[k : k + 1000]
                        yield pa.record_batch({"file": pa.array([name] * len(part)), "block": pa.array([0] * len(part), pa.int64()), "row": pa.array(range(k, k + len(part)), pa.int64()), "record": pa.array(part)})

        rows = files.mapInArrow(split, "file string, block long, row long, record string")
        return _records(rows.select("file", F.struct("block", "row").alias("place"), "record"))
    rows = spark.read.option("lineSep", "\n>").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("record"))
    return _records(rows.select("file", F.struct("block", "row").alias("place"), "record").where("trim(record) <> ''"))


def headless_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file): files whose text does not start with `>`."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.startswith("value", F.lit(">")).alias("first"))
    return rows.groupBy("file").agg(F.bool_or("first").alias("ok")).where("not ok").select("file")


def indexed(records: DataFrame, least: int = 0) -> DataFrame:
    """(contig_idx, name, seq, length) of the records of at least `least` bases, numbered from 0 in their order.

    Numbers are counted by file block first and placed within a block then, so that no task holds all records.
    """
    kept = records.where(F.col("length") >= least).withColumn("block", F.col("place.block"))
    counts = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", "block", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("place")) - 1
    return kept.withColumn("inside", inside).join(before, ["file", "block"]).select((F.col("before") + F.col("inside")).alias("contig_idx"), "name", "seq", "length")


def write_fasta(contigs: DataFrame, path: str, compress: bool = False) -> None:
    """contigs (name, seq), wrapped at 60, in the order of contig_idx if they have one."""
    rows = contigs.orderBy("contig_idx") if "contig_idx" in contigs.columns else contigs
    rows.select(fasta_record(F.col("name"), F.col("seq")).alias("value")).write.option("compression", "gzip" if compress else "none").text(path)


def write_bins(members: DataFrame, contigs: DataFrame, path: str, compress: bool = False, max_bins: int | None = 1000) -> tuple[int, int]:
    """A folder bin=NAME of FASTA for each bin of members (bin, name); returns the numbers of bins and contigs.

    More bins than max_bins are a ValueError, a contig that is missing is a KeyError.
    """
    once = members.select("bin", "name").distinct()
    n_bins, n = once.agg(F.count_distinct("bin"), F.count(F.lit(1))).first()
    if max_bins is not None and n_bins > max_bins:
        raise ValueError(f"{n_bins} bins are more than {max_bins}")
    missing = once.join(contigs, "name", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0]["name"])
    rows = once.join(contigs.select("name", "seq"), "name").select("bin", fasta_record(F.col("name"), F.col("seq")).alias("value"))
    rows.repartition("bin").write.partitionBy("bin").option("compression", "gzip" if compress else "none").text(path)
    return n_bins, n
