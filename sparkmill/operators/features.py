"""Model inputs from composition, abundance and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.functions.vectors import zscored
from sparkmill.operators.abundance import scaled


def length_weights(contigs: DataFrame) -> DataFrame:
    """(contig_idx, weight): log(length) - 5, at least 2, scaled to a mean of one."""
    raw = contigs.select("contig_idx", F.greatest(F.log(F.col("length").cast("double")) - 5, F.lit(2.0)).alias("w"))
    n, total = raw.agg(F.count(F.lit(1)), F.sum("w")).first()
    return raw.select("contig_idx", (F.col("w") * F.lit(float(n)) / F.lit(total)).alias("weight"))


def total_abundance(shares: DataFrame) -> DataFrame:
    """(contig_idx, total_ab): z-score over all contigs of log(total), totals held at 0.001 at least."""
    totals = shares.groupBy("contig_idx").agg(F.first("total").alias("total"))
    logs = totals.select("contig_idx", F.log(F.greatest("total", F.lit(0.001))).alias("l"))
    return zscored(logs, "l", out="total_ab").select("contig_idx", "total_ab")


def column_zscores(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """vectors with each dimension z-scored over all rows; the sums of all dimensions come from one pass."""
    dims = [F.col(column)[i].cast("double") for i in range(size)]
    row = vectors.agg(*[F.avg(d).alias(f"m{i}") for i, d in enumerate(dims)], *[F.stddev_pop(d).alias(f"s{i}") for i, d in enumerate(dims)]).first()
    means = F.array(*[F.lit(row[f"m{i}"]) for i in range(size)])
    spreads = F.array(*[F.lit(row[f"s{i}"] or 1.0) for i in range(size)])
    z = F.zip_with(F.zip_with(column, means, lambda x, m: x - m), spreads, lambda x, s: (x / s).cast("float"))
    return vectors.withColumn(column, z)


def features(contigs: DataFrame, depths: DataFrame, tnf: DataFrame, n_samples: int, tnf_size: int = 103) -> DataFrame:
    """(contig_idx, depths array<float>, tnf array<float>, total_ab float, weight float), samples in their order.

    At least two contigs, no sample without depth.
    """
    shares = scaled(depths, n_samples)
    arrays = shares.groupBy("contig_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "share"))), lambda x: x["share"].cast("float")).alias("depths"))
    z = column_zscores(tnf, "tnf", tnf_size)
    out = arrays.join(z, "contig_idx").join(total_abundance(shares), "contig_idx").join(length_weights(contigs), "contig_idx")
    return out.select("contig_idx", "depths", "tnf", F.col("total_ab").cast("float"), F.col("weight").cast("float"))
