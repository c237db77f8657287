"""Exchange of dense matrices with NumPy archives, by the driver and for sizes that fit it; Parquet is the native form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_latent(latent: DataFrame, path: str) -> None:
    """latent (contig_idx, v) as one float32 matrix in the order of contig_idx."""
    t = latent.select("contig_idx", "v").toArrow().sort_by("contig_idx")
    np.savez_compressed(path, np.array(t["v"].to_pylist(), np.float32))


def load_latent(spark: SparkSession, path: str) -> DataFrame:
    with np.load(path) as f:
        rows = f["arr_0"] if "arr_0" in f.files else f
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "contig_idx long, v array<float>")


def save_composition(contigs: DataFrame, tnf: DataFrame, path: str, minlength: int) -> None:
    """Matrix, identifiers, lengths, mask and least length of kept contigs (contig_idx, name, length)."""
    t = contigs.join(tnf, "contig_idx").select("contig_idx", "name", "length", "tnf").toArrow().sort_by("contig_idx")
    n = len(t)
    np.savez_compressed(path, matrix=np.array(t["tnf"].to_pylist(), np.float32).reshape(n, -1), identifiers=np.array(t["name"].to_pylist(), dtype=str), lengths=t["length"].to_numpy(), mask=np.ones(n, bool), minlength=np.array(minlength))


def load_composition(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((contig_idx, name, length), (contig_idx, tnf)); names must be unique and lengths at least the least one."""
    with np.load(path, allow_pickle=False) as f:
        matrix, names, lengths, least = f["matrix"], f["identifiers"].tolist(), f["lengths"].tolist(), int(f["minlength"])
    if len(set(names)) != len(names) or len(names) != len(matrix) or any(x < least for x in lengths):
        raise ValueError(f"{path} is not a sound composition")
    contigs = spark.createDataFrame([(i, str(n), int(x)) for i, (n, x) in enumerate(zip(names, lengths))], "contig_idx long, name string, length int")
    return contigs, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix.astype(np.float32))], "contig_idx long, tnf array<float>")


def save_abundance(depths: DataFrame, samples: list[str], path: str, refhash: str = "", minid: float = 0.0) -> None:
    """Long depths (contig_idx, sample, depth) as one float32 matrix."""
    wide = depths.groupBy("contig_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "depth"))), lambda x: x["depth"]).alias("d")).toArrow().sort_by("contig_idx")
    np.savez_compressed(path, matrix=np.array(wide["d"].to_pylist(), np.float32).reshape(-1, len(samples)), samplenames=np.array(samples, dtype=str), minid=np.array(minid), refhash=np.array(refhash))


def load_abundance(spark: SparkSession, path: str, refhash: str | None = None) -> tuple[DataFrame, list[str]]:
    """(long depths, sample names); another refhash than the expected one is an error."""
    with np.load(path, allow_pickle=False) as f:
        matrix, samples, found = f["matrix"], f["samplenames"].tolist(), str(f["refhash"])
    if refhash is not None and found != refhash:
        raise ValueError(f"{path} belongs to other contigs")
    rows = [(i, j, float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "contig_idx long, sample int, depth double"), samples
