"""Contigs and their tetranucleotide composition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.functions.sequences import FOUR_MERS

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


def min_length(contigs: DataFrame, least: int) -> DataFrame:
    """Contigs of at least so many bases."""
    return contigs.where(F.col("length") >= least)


def dataset_totals(contigs: DataFrame, least: int) -> DataFrame:
    """One row: number of contigs and bases kept, contigs removed."""
    kept = F.col("length") >= least
    return contigs.agg(F.count_if(kept).alias("n_seqs"), F.sum(F.when(kept, F.col("length").cast("long")).otherwise(0)).alias("n_bases"), F.count_if(~kept).alias("n_removed"))


def count_four_mers(seq: bytes) -> np.ndarray:
    """Counts of the 256 overlapping 4-mers in lexicographic order; windows with another letter than A, C, G or T are skipped."""
    code = _CODE[np.frombuffer(seq, np.uint8)]
    if len(code) < 4:
        return np.zeros(256, np.int64)
    a, b, c, d = (code[i : len(code) - 3 + i].astype(np.int16) for i in range(4))
    sound = (a < 4) & (b < 4) & (c < 4) & (d < 4)
    return np.bincount((a * 64 + b * 16 + c * 4 + d)[sound], minlength=256)


def kmer_vectors(contigs: DataFrame, idx: str = "contig_idx", seq: str = "seq") -> DataFrame:
    """(contig_idx, counts array<int>) of 256 counts for every contig; no shuffle, each sequence is read once."""
    rows = contigs.select(idx, F.col(seq).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.concatenate([count_four_mers(s.as_py() or b"") for s in b.column(1)] or [np.zeros(0)]).astype(np.int32)
            offsets = np.arange(0, len(flat) + 1, 256, dtype=np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[idx, "counts"])

    return rows.mapInArrow(run, f"{idx} {dict(rows.dtypes)[idx]}, counts array<int>")


def kmer_counts(vectors: DataFrame, idx: str = "contig_idx") -> DataFrame:
    """(contig_idx, kmer, n) for the 4-mers that occur."""
    names = F.array(*[F.lit(k) for k in FOUR_MERS])
    return vectors.select(idx, F.explode(F.arrays_zip(names.alias("kmer"), F.col("counts").alias("n"))).alias("x")).select(idx, "x.kmer", F.col("x.n").cast("long").alias("n")).where("n > 0")


def kmer_frequencies(vectors: DataFrame, idx: str = "contig_idx") -> DataFrame:
    """(contig_idx, kmer, freq) averaged over a 4-mer and its reverse complement, for those that occur.

    Row by row on the vectors of counts: nothing is shuffled.
    """
    turn = str.maketrans("ACGT", "TGCA")
    mates = F.array(*[F.lit(FOUR_MERS.index(k.translate(turn)[::-1])) for k in FOUR_MERS])
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    both = F.transform("counts", lambda x, i: x + F.get(F.col("counts"), F.get(F.col("mates"), i)))
    rows = vectors.select(idx, "counts", mates.alias("mates"), total.alias("total")).where("total > 0").select(idx, "total", both.alias("both"))
    names = F.array(*[F.lit(k) for k in FOUR_MERS])
    long = rows.select(idx, "total", F.explode(F.arrays_zip(names.alias("kmer"), F.col("both").alias("n"))).alias("x")).where("x.n > 0")
    return long.select(idx, "x.kmer", (F.col("x.n") / (2 * F.col("total"))).alias("freq"))


@lru_cache(maxsize=1)
def kernel() -> np.ndarray:
    """256 x 103: an orthonormal basis of what is left of 4-mer frequencies beyond their constraints.

    Constraints: they sum to one; a 4-mer and its reverse complement are equal; a 3-mer is as often a prefix as a suffix.
    The space is unique but its basis is not: unit vectors are projected to it in order, each made orthogonal to those
    before, so that every process comes to the same columns.
    """
    at = {k: i for i, k in enumerate(FOUR_MERS)}
    turn = str.maketrans("ACGT", "TGCA")
    rows = [np.ones(256)]
    for k in FOUR_MERS:
        other = k.translate(turn)[::-1]
        if k < other:
            rows.append(np.eye(256)[at[k]] - np.eye(256)[at[other]])
    for three in sorted({k[:3] for k in FOUR_MERS}):
        row = np.zeros(256)
        for c in "ACGT":
            row[at[three + c]] += 1
            row[at[c + three]] -= 1
        rows.append(row)
    a = np.array(rows)
    space = np.eye(256) - np.linalg.pinv(a, rcond=1e-10) @ a
    basis = np.zeros((256, 0))
    for i in range(256):
        v = space[:, i]
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
        if np.linalg.norm(v) > 1e-6:
            basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


def project(counts: np.ndarray) -> np.ndarray:
    """103 composition features of rows of 256 counts; a row without a 4-mer counts as all zero."""
    counts = np.asarray(counts, np.float64)
    sums = counts.sum(axis=1, keepdims=True)
    sums[sums == 0] = 1
    return ((counts / sums - 1 / 256) @ kernel()).astype(np.float32)


def composition(vectors: DataFrame, idx: str = "contig_idx") -> DataFrame:
    """(contig_idx, tnf array<float>) of 103 features, the 12 lowest mantissa bits zero; a contig without a 4-mer is an error."""
    from sparkmill.functions.vectors import masked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = b.column(1).flatten().to_numpy().reshape(-1, 256)
            if len(counts) and (counts.sum(axis=1) == 0).any():
                raise ValueError("a sequence has no 4-mer of A, C, G and T")
            flat = masked(project(counts).ravel(), 12)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 103, dtype=np.int32)), pa.array(flat))], names=[idx, "tnf"])

    return vectors.select(idx, "counts").mapInArrow(run, f"{idx} {dict(vectors.dtypes)[idx]}, tnf array<float>")


def concatenated(files: DataFrame, least: int, rename: bool = True) -> DataFrame:
    """(file_ord, name, seq) of all files' contigs (file_ord, name, seq) of at least `least` bases, named S{file}C{name} if renaming."""
    kept = files.where(F.length("seq") >= least)
    return kept.withColumn("name", F.concat(F.lit("S"), F.col("file_ord").cast("string"), F.lit("C"), "name")) if rename else kept


def duplicate_names(contigs: DataFrame, *scope: str) -> DataFrame:
    """Names that occur more than once within the scope: what a loader must refuse."""
    return contigs.groupBy(*scope, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
