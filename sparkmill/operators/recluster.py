"""Splitting and choosing bins by single-copy markers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.operators import markers as mk
from sparkmill.operators.graph import components, stored
from sparkmill.operators.neighbours import linked, normalised

#: Radii that density reclustering tries, in order (fixed values): 17 from 0.01 in steps of 0.02; in whole cosine distance.
RADII = tuple(round(0.01 + 0.02 * i, 2) for i in range(17))
#: So many radii in a row that are worse than the best end the search.
PATIENCE = 2
#: Rows of clusters that go to Python together, on average.
BUCKET_ROWS = 20_000


def lloyd(x: np.ndarray, weight: np.ndarray, centres: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weighted k-means from given centres; a centre without points stays where it is."""
    label = np.full(len(x), -1)
    for _ in range(rounds):
        d = ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T) + (centres * centres).sum(axis=1)
        new = d.argmin(axis=1)
        if (new == label).all():
            break
        label = new
        mass = np.bincount(label, weight, len(centres))
        for j in np.flatnonzero(mass):
            centres[j] = (weight[label == j, None] * x[label == j]).sum(axis=0) / mass[j]
    return label


def _split(rows: pa.Table) -> pa.Table:
    """Whole clusters, each cut by k-means from its seeds."""
    rows = rows.sort_by([("cluster", "ascending"), ("contig_idx", "ascending")])
    new = np.append(pc.not_equal(rows["cluster"][1:], rows["cluster"][:-1]).to_numpy(), True) if rows.num_rows else np.zeros(0, bool)
    ends = np.flatnonzero(new) + 1
    x = rows["v"].combine_chunks()
    lengths, seed, part = rows["length"].to_numpy().astype(float), rows["is_seed"].to_numpy(), np.zeros(rows.num_rows, np.int64)
    for s, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        v = x.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(e - s, -1)
        part[s:e] = lloyd(v, lengths[s:e], v[seed[s:e]].copy())
    return pa.table({"cluster": rows["cluster"], "part": part, "contig_idx": rows["contig_idx"]})


def recluster_kmeans(members: DataFrame, latent: DataFrame, contig_markers: DataFrame, n_markers: int) -> DataFrame:
    """(cluster, part, contig_idx): clusters of two and more contigs whose upper median marker count is at least two are split.

    k-means starts from the carriers of the seed marker and weighs contigs by length; all other clusters stay as part 0 and
    never reach Python. Clusters go to Python by the bucket of about BUCKET_ROWS rows, as there may be a great many small ones.
    """
    contig_markers = stored(contig_markers)
    counts = stored(mk.marker_counts(members, contig_markers))
    medians = stored(mk.upper_median(members, counts, n_markers))
    lengths = latent.select("contig_idx", "length")
    seeds = mk.kmeans_seeds(members, contig_markers, lengths, counts, medians).select("cluster", "contig_idx", F.lit(True).alias("is_seed"))
    rows = members.join(latent, "contig_idx").join(seeds, ["cluster", "contig_idx"], "left").select("cluster", "contig_idx", "v", "length", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
    rows = stored(rows)
    several = rows.where("is_seed").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    schema = f"cluster {dict(members.dtypes)['cluster']}, part long, contig_idx long"
    bucket = F.pmod(F.xxhash64("cluster"), F.lit(rows.count() // BUCKET_ROWS + 1)).alias("bucket")
    split = rows.join(several, "cluster", "left_semi").select(bucket, *rows.columns).groupBy("bucket").applyInArrow(_split, schema)
    whole = rows.join(several, "cluster", "left_anti").select("cluster", F.lit(0).cast("long").alias("part"), F.col("contig_idx").cast("long"))
    return split.unionByName(whole)


def density_clusters(points: DataFrame, radius: float, by: tuple[str, ...] = ("genus",)) -> DataFrame:
    """(contig_idx, cluster): components of the graph of contigs of one genus (null is one) within `radius` in cosine distance.

    As contigs weigh their length, which is far above the least weight of a core point, every contig is one, and density
    clusters are these components.
    """
    edges = linked(points, radius / 2, by)  # distances of normalised points are halved
    return components(edges.select("a", "b"), points.select(F.col("contig_idx").alias("node"))).select(F.col("node").alias("contig_idx"), F.col("component").alias("cluster"))


def density_levels(points: DataFrame, radii: tuple[float, ...], by: tuple[str, ...] = ("genus",)) -> Iterator[tuple[float, DataFrame, bool]]:
    """(radius, density clusters, whether they differ from those before) for rising radii, all from one comparison of the points at the largest.

    The edges that this gives hold the components at every radius. What a radius adds joins clusters of the radius before,
    so each edge is looked at once.
    """
    edges = stored(linked(points, radii[-1] / 2, by))
    found, before = stored(points.select("contig_idx", F.col("contig_idx").alias("cluster"))), -1.0
    for radius in radii:
        new = edges.where((F.col("distance") > before) & (F.col("distance") <= radius / 2)).select("a", "b")
        changed = not new.isEmpty()
        if changed:
            for end in "ab":
                new = new.join(found.select(F.col("contig_idx").alias(end), F.col("cluster").alias(f"of_{end}")), end)
            joined = components(new.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("cluster"), "component")
            found = stored(found.join(joined, "cluster", "left").select("contig_idx", F.coalesce("component", "cluster").alias("cluster")))
        yield radius, found, changed or before < 0
        before = radius / 2


def best_level(levels: Iterator[tuple[float, Any, bool]], good: Callable[[Any], int]) -> tuple[Any, float] | None:
    """(clusters, radius) of the level with most good genomes, the first of equal ones; while none has any, the latest.

    More than PATIENCE levels in a row that are worse than the best end the search; one as good as the best starts the count anew.
    """
    best, chosen, worse, score = 0, None, 0, 0
    for radius, found, changed in levels:
        score = good(found) if changed else score
        if best == 0 or score > best:
            best, chosen = score, (found, radius)
        worse = 0 if score >= best else worse + 1
        if worse > PATIENCE:
            break
    return chosen


def recluster_density(latent: DataFrame, contig_markers: DataFrame, n_markers: int, radii: tuple[float, ...] = RADII, by: tuple[str, ...] = ("genus",)) -> tuple[DataFrame, float]:
    """(clusters, radius): density clusters of the radius with most good genomes, see best_level."""
    points = stored(normalised(latent))

    def good(found: DataFrame) -> int:
        counts = mk.marker_counts(found, contig_markers)
        return mk.good_genomes(mk.bin_quality(found, counts, n_markers)).first()[0]

    return best_level(density_levels(points, radii, by), good)
