"""Distances, neighbourhoods and densities of latent vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.functions.vectors import half_distance, half_unit
from sparkmill.operators import pivots
from sparkmill.sources.scratch import numbered

#: Radii and histogram of the density scan (fixed values): medoid and default radius, bin width, end of the histogram.
MEDOID_RADIUS, DEFAULT_RADIUS, DELTA_X, X_MAX = 0.05, 0.06, 0.005, 0.3
N_BINS = 60
#: Half of the smoothing window and the deviation of its normal weights, in distance.
HALF_WINDOW, SIGMA = 15, 0.01


def normalised(latent: DataFrame, v: str = "v") -> DataFrame:
    return latent.withColumn(v, half_unit(F.col(v)))


def distances_from(points: DataFrame, medoid: int, idx: str = "contig_idx") -> DataFrame:
    """points (normalised) with their distance to one of them; that one's vector goes into the plan as a literal."""
    row = points.where(F.col(idx) == medoid).select("v").first()
    if row is None:
        raise KeyError(medoid)
    target = F.array(*[F.lit(x) for x in row[0]])
    d = F.when(F.col(idx) == medoid, 0.0).otherwise(half_distance(F.col("v"), target))
    return points.withColumn("distance", d)


def neighbours(points: DataFrame, radius: float, by: tuple[str, ...] = (), idx: str = "contig_idx", **sizes: int) -> DataFrame:
    """Pairs (*by, a, b, distance) with a < b within the radius, of normalised points, equal in `by` (nulls are equal); see pivots for the way."""
    return pivots.near(points, radius, by, idx, **sizes)


def linked(points: DataFrame, radius: float, by: tuple[str, ...] = (), idx: str = "contig_idx", **sizes: int) -> DataFrame:
    """Edges (a, b, distance) that connect what the pairs within the radius connect, and so at every smaller radius; few where many points are near each other."""
    return pivots.near_forest(points, radius, by, idx, **sizes)


def local_density(points: DataFrame, radius: float = MEDOID_RADIUS, idx: str = "contig_idx", **sizes: int) -> DataFrame:
    """(contig_idx, density): sum of length * (radius - distance) over all normalised points (with their length) within the radius, itself included."""
    sums = pivots.near_sums(points, radius, "length", (), idx, **sizes)
    return points.select(idx, "length").join(sums, idx, "left").select(idx, (F.col("length") * radius + F.coalesce("near", F.lit(0.0))).alias("density"))


def bin_of(distance: Column) -> Column:
    """0-based bin of a distance, the last edge belonging to the last bin."""
    return F.least(F.floor(distance / F.lit(DELTA_X)), F.lit(N_BINS - 1)).cast("int")


def histogram(distances: DataFrame) -> DataFrame:
    """(bin, mass): lengths of the points (distance, length) at most X_MAX away, by bin."""
    return distances.where(F.col("distance") <= X_MAX).groupBy(bin_of(F.col("distance")).alias("bin")).agg(F.sum(F.col("length").cast("double")).alias("mass"))


def smoothed(hist: DataFrame) -> DataFrame:
    """(bin, density) for all bins: the histogram spread with normal weights over 31 bins. Each bin adds to 31 at most."""
    weight = F.exp(-F.pow((F.col("bin") - F.col("to")) * DELTA_X / SIGMA, F.lit(2.0)) / 2) * DELTA_X / (SIGMA * math.sqrt(2 * math.pi))
    spread = hist.withColumn("to", F.explode(F.sequence(F.greatest(F.col("bin") - HALF_WINDOW, F.lit(0)), F.least(F.col("bin") + HALF_WINDOW, F.lit(N_BINS - 1)))))
    sums = spread.groupBy(F.col("to").alias("bin")).agg(F.sum(weight * F.col("mass")).alias("density"))
    every = hist.sparkSession.range(N_BINS).select(F.col("id").cast("int").alias("bin"))
    return every.join(sums, "bin", "left").select("bin", F.coalesce("density", F.lit(0.0)).alias("density"))


def seed_order(contigs: DataFrame) -> DataFrame:
    """(contig_idx, seed_rank): the longest first, of equal ones the higher index, from 1; sorted by range, however many are equal."""
    return numbered(contigs.select("contig_idx", "length"), [F.desc("length"), F.desc("contig_idx")]).select("contig_idx", (F.col("i") + 1).alias("seed_rank"))
