"""Single-copy markers: hits, counts and the quality of bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.functions.names import marker_name

MAX_MARKERS = 256


def accepted_hits(hits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Distinct (contig_idx, marker): hits (contig_idx, model, score) that reach their model's cutoff, synonyms made one."""
    kept = hits.join(cutoffs, "model").where("score >= cutoff")
    return kept.select("contig_idx", marker_name(F.col("model")).alias("marker")).distinct()


def marker_counts(members: DataFrame, markers: DataFrame) -> DataFrame:
    """(cluster, marker, n): contigs of a cluster (cluster, contig_idx) that carry a marker (contig_idx, marker)."""
    return members.join(markers, "contig_idx").groupBy("cluster", "marker").agg(F.count(F.lit(1)).alias("n"))


def bin_quality(members: DataFrame, counts: DataFrame, n_markers: int) -> DataFrame:
    """(cluster, n_unique, n_total, completeness, contamination) of every cluster, also of those without a marker."""
    sums = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_total"))
    rows = members.select("cluster").distinct().join(sums, "cluster", "left")
    unique, total = F.coalesce("n_unique", F.lit(0)), F.coalesce("n_total", F.lit(0))
    return rows.select("cluster", unique.alias("n_unique"), total.alias("n_total"), (unique / n_markers).alias("completeness"), ((total - unique) / n_markers).alias("contamination"))


def unsaturated(quality: DataFrame, n_markers: int) -> DataFrame:
    """Clusters whose surplus copies are not more than the markers."""
    return quality.where(F.col("n_total") - F.col("n_unique") <= n_markers)


def good_genomes(quality: DataFrame, least_completeness: float = 0.75, most_contamination: float = 0.3) -> DataFrame:
    """One row: number of clusters that are complete and clean enough."""
    return quality.agg(F.count_if((F.col("completeness") >= least_completeness) & (F.col("contamination") <= most_contamination)).alias("n_good"))


def near_complete(quality: DataFrame, least_completeness: float = 0.9, most_contamination: float = 0.05) -> DataFrame:
    """Rows of quality (percent) that are complete and clean enough (fractions)."""
    return quality.where((F.col("completeness") / 100 >= least_completeness) & (F.col("contamination") / 100 <= most_contamination))


def upper_median(members: DataFrame, counts: DataFrame, n_markers: int) -> DataFrame:
    """(cluster, median): the element n div 2 (from 0) of the sorted counts of all markers, those that are missing being zero.

    With z missing markers it is 0 for z > n div 2, else the element n div 2 - z of those present.
    """
    present = counts.groupBy("cluster").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    at = F.lit(n_markers // 2) - (n_markers - F.size("ns"))
    rows = members.select("cluster").distinct().join(present, "cluster", "left")
    return rows.select("cluster", F.coalesce(F.when(at >= 0, F.get("ns", at)), F.lit(0)).cast("long").alias("median"))


def kmeans_seeds(members: DataFrame, markers: DataFrame, lengths: DataFrame, counts: DataFrame, medians: DataFrame) -> DataFrame:
    """(cluster, marker, contig_idx): for clusters of median >= 2, the contigs with the marker of median count whose shortest contig is longest (of equal ones the first marker)."""
    candidates = counts.join(medians.where("median >= 2"), "cluster").where("n = median").select("cluster", "marker")
    carriers = members.join(markers, "contig_idx").join(candidates, ["cluster", "marker"]).join(lengths, "contig_idx")
    shortest = carriers.groupBy("cluster", "marker").agg(F.min("length").alias("least"))
    chosen = shortest.groupBy("cluster").agg(F.min(F.struct((-F.col("least")).alias("l"), F.col("marker").alias("marker"))).alias("x")).select("cluster", "x.marker")
    return carriers.join(chosen, ["cluster", "marker"]).select("cluster", "marker", "contig_idx")
