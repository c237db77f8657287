"""Functions on contig, sample, bin and marker names, and the order-sensitive digest of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.sources.scratch import stored

#: Names in a block whose digests are compared before the names.
BLOCK = 4096
#: Marker synonyms (fixed values): one marker under two accessions.
MARKER_SYNONYMS = {"TIGR00388": "TIGR00389", "TIGR00471": "TIGR00472", "TIGR00408": "TIGR00409", "TIGR02386": "TIGR02387"}


def sample_of(name: Column, sep: str) -> Column:
    """What stands before the first separator."""
    return F.substring_index(name, sep, 1)


def rest_of(name: Column, sep: str) -> Column:
    """What follows the first separator; empty if there is none."""
    return F.regexp_extract(name, "(?s)^.*?" + _quoted(sep) + "(.*)$", 1)


def _quoted(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in sep)


def splits(name: Column, sep: str) -> Column:
    """Both sides of the first separator are non-empty."""
    return (F.instr(name, sep) > 1) & (F.length(rest_of(name, sep)) > 0)


def bin_name(sample: Column, sep: str, cluster: Column) -> Column:
    return F.concat(sample, F.lit(sep), cluster)


def renamed(file_number: Column, contig: Column) -> Column:
    """S{file}C{contig}."""
    return F.concat(F.lit("S"), file_number.cast("string"), F.lit("C"), contig)


def marker_name(name: Column) -> Column:
    """The name that all synonyms share."""
    table = F.create_map(*[F.lit(x) for pair in MARKER_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def refhash(df: DataFrame, idx: str = "contig_idx", name: str = "name", groups: tuple[str, ...] = ()) -> DataFrame:
    """MD5 of the right-stripped names in the order of idx, one row for each group."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.regexp_replace(name, r"\s+$", "").alias("n"))))
    return df.groupBy(*groups).agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["n"]), "").cast("binary")).alias("refhash"))


def _digests(df: DataFrame, idx: str, name: str) -> DataFrame:
    """(block, n, x): rows and two hashes, combined in any order, of what a block of the index has; a name that is null is told from an empty one."""
    text = F.regexp_replace(name, r"\s+$", "")
    own = [F.xxhash64(F.lit(k), idx, text.isNull(), text) for k in (0, 1)]
    return df.groupBy(F.floor(F.col(idx) / BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.struct(F.bit_xor(own[0]), F.sum(own[1].cast("decimal(38,0)"))).alias("x"))


def check_refhash(df: DataFrame, expected: str | None, what: str) -> None:
    """A ValueError unless the names of df (contig_idx, name) have the expected digest; null or empty: not known, so not checked."""
    if expected and refhash(df).first()["refhash"] != expected:
        raise ValueError(f"{what} belong to other contigs")


def refhash_difference(left: DataFrame, right: DataFrame, idx: str = "contig_idx", name: str = "name") -> DataFrame:
    """Where two name lists differ: (idx, left_name, right_name), nulls for what one side lacks.

    Digests of blocks of the index, which are summed up before the shuffle, are compared first; only blocks that differ are joined name by name.
    """
    odd = _digests(left, idx, name).join(_digests(right, idx, name).withColumnsRenamed({"n": "m", "x": "y"}), "block", "full_outer")
    odd = stored(odd.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("x").eqNullSafe(F.col("y")))).select("block"))
    left, right = (df.withColumn("block", F.floor(F.col(idx) / BLOCK)).join(odd, "block", "left_semi") for df in (left, right))
    a = left.select(idx, F.regexp_replace(name, r"\s+$", "").alias("left_name"))
    b = right.select(idx, F.regexp_replace(name, r"\s+$", "").alias("right_name"))
    return a.join(b, idx, "full_outer").where(~F.col("left_name").eqNullSafe(F.col("right_name")))
