"""Depths of contigs in samples: merging, filling, trimmed means and normalisation, all in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.sources.scratch import dealt, stored


def filled(depths: DataFrame, contigs: DataFrame, samples: list[int] | list[str]) -> DataFrame:
    """(contig_idx, sample, depth) for every contig and each of the samples, 0 where none is given."""
    every = contigs.select("contig_idx", F.explode(F.array(*[F.lit(s) for s in samples])).alias("sample"))
    return every.join(depths, ["contig_idx", "sample"], "left").select("contig_idx", "sample", F.coalesce("depth", F.lit(0.0)).alias("depth"))


def merged_wide(depths: DataFrame, samples: list) -> DataFrame:
    """One row a contig, one column a sample; null where a sample lacks the contig."""
    wide = depths.groupBy("contig_idx").pivot("sample", samples).agg(F.first("depth"))
    return wide.select("contig_idx", *[F.col(f"`{s}`").alias(f"sample_{s}") for s in samples])


def merge_faults(depths: DataFrame, n_samples: int) -> DataFrame:
    """Contigs that some sample lacks or has twice: (contig_idx, n_samples, n_rows)."""
    seen = depths.groupBy("contig_idx").agg(F.count_distinct("sample").alias("n_samples"), F.count(F.lit(1)).alias("n_rows"))
    return seen.where((F.col("n_samples") != n_samples) | (F.col("n_rows") != n_samples))


#: Positions that one window of a sweep holds at most.
TILE = 1 << 16


def trimmed_mean_of_runs(runs: DataFrame, keys: list[str], trim: float = 0.1) -> DataFrame:
    """Trimmed mean of each key's depths, given how many bases have each: runs (keys, depth, bases), a row for each depth of a key.

    As many bases as floor(trim * n) go at either end. Costs the number of different depths, not of bases; null depths stand lowest and don't enter the mean.
    """
    w = Window.partitionBy(*keys)
    ranked = runs.select(*keys, "depth", "bases", F.sum("bases").over(w.orderBy("depth")).alias("upto"), F.sum("bases").over(w).alias("n"))
    cut = F.floor(F.col("n") * trim)
    kept = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("n") - cut) - F.greatest(F.col("upto") - F.col("bases"), cut))
    kept = F.when(F.col("depth").isNotNull(), kept)
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("depth") * kept), F.sum(kept)).alias("depth"))


def trimmed_mean(per_base: DataFrame, key: str = "contig_idx", value: str = "depth", trim: float = 0.1) -> DataFrame:
    """Mean of each key's values without the lowest and the highest share `trim` of them (as many as floor(share * n)); equal values are counted first."""
    return trimmed_mean_of_runs(per_base.groupBy(key, F.col(value).alias("depth")).agg(F.count(F.lit(1)).alias("bases")), [key], trim)


def depth_runs(intervals: DataFrame, lengths: DataFrame, keys: list[str], tile: int = TILE, ends: int = 0) -> DataFrame:
    """(keys, depth, bases): how many bases of each key lie under how many of its half-open intervals (keys, start, end); lengths: (keys, length).

    A sweep over the places where the depth changes: no row for each base. Changes are
    swept by tiles of `tile` positions, each of which gets the depth at its start from the sums of the tiles before it, so
    no task holds a key. Tasks get a number of changes that doesn't grow with the table. `ends` bases at either end of a key are left out.
    Empty intervals count nothing; an interval beyond its key's length, or of a key without one, is an error.
    """
    n = 2 * intervals.count()
    changes = F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).alias("change")), F.struct(F.col("end").cast("long").alias("pos"), F.lit(-1).alias("change"))))
    events = intervals.where("end > start").select(*keys, changes.alias("e")).select(*keys, F.floor(F.col("e.pos") / tile).alias("tile"), F.col("e.pos").alias("pos"), F.col("e.change").alias("change"))
    events = dealt(events, n, *keys, "tile").groupBy(*keys, "tile", "pos").agg(F.sum("change").alias("change")).where("change <> 0")
    inside = Window.partitionBy(*keys, "tile").orderBy("pos")
    swept = events.select(*keys, "tile", "pos", F.sum("change").over(inside).alias("depth"), F.lead("pos").over(inside).alias("next"), F.first("pos").over(inside).alias("first"))
    swept = stored(swept)
    tiles = swept.where("next is null").select(*keys, "tile", F.col("depth").alias("net"), "first", F.col("pos").alias("last"))  # a tile's last change
    sizes = lengths.select(*keys, F.col("length").cast("long").alias("length"))
    m = tiles.count() + sizes.count()
    tiles = dealt(sizes, m, *keys).join(dealt(tiles, m, *keys), keys, "full")
    fits = F.col("tile").isNull() | (F.col("length").isNotNull() & (F.col("first") >= 0) & (F.col("last") <= F.col("length")))
    tiles = tiles.withColumn("length", F.when(fits, F.col("length")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("an interval beyond its reference:"), *[F.col(k).cast("string") for k in keys])).cast("long")))
    w = Window.partitionBy(*keys).orderBy("tile")  # a row for each tile that has changes
    before = F.coalesce(F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead_in = F.when(F.row_number().over(w) == 1, F.coalesce("first", "length"))
    tiles = stored(tiles.select(*keys, "tile", "length", before.alias("entry"), F.coalesce(F.lead("first").over(w), F.col("length")).alias("stop"), lead_in.alias("lead_in")))
    bases = lambda start, end: (F.least(end, F.col("length") - ends) - F.greatest(start, F.lit(ends))).alias("bases")
    entries = tiles.where("tile is not null").select(*keys, "tile", "length", "entry", "stop")
    rows = dealt(swept.drop("first"), n, *keys, "tile").join(dealt(entries, n, *keys, "tile"), [*keys, "tile"])
    rows = rows.select(*keys, "tile", (F.col("entry") + F.col("depth")).alias("depth"), bases(F.col("pos"), F.coalesce("next", "stop"))).where("bases > 0")
    rows = rows.groupBy(*keys, "tile", "depth").agg(F.sum("bases").alias("bases")).drop("tile")
    starts = tiles.where("lead_in is not null").select(*keys, F.lit(0).cast("long").alias("depth"), bases(F.lit(0).cast("long"), F.col("lead_in"))).where("bases > 0")
    return dealt(rows.unionByName(starts), n + m, *keys).groupBy(*keys, "depth").agg(F.sum("bases").alias("bases"))


def trimmed_mean_of_intervals(intervals: DataFrame, lengths: DataFrame, keys: list[str], trim: float = 0.1, ends: int = 0) -> DataFrame:
    """(keys, depth): trimmed mean of how many half-open intervals (keys, start, end) lie over each base of every key of lengths (keys, length).

    `ends` bases at either end are left out; a key that has no more than these has depth 0, as has one without intervals.
    """
    means = trimmed_mean_of_runs(depth_runs(intervals, lengths, keys, ends=ends), keys, trim)
    return lengths.select(*keys).join(means, keys, "left").select(*keys, F.coalesce("depth", F.lit(0.0)).alias("depth"))


def scaled(depths: DataFrame, n_samples: int) -> DataFrame:
    """Depths scaled to a million a sample, with each contig's total and its share of every sample.

    (contig_idx, sample, depth, total, share); a contig without any depth has equal shares. A sample without any is an error.
    """
    sums = depths.groupBy("sample").agg(F.sum("depth").alias("of_sample"))  # one row a sample
    sums = sums.withColumn("of_sample", F.when(F.col("of_sample") == 0, F.raise_error(F.lit("a sample has zero depth in all contigs"))).otherwise(F.col("of_sample")))
    per_million = depths.join(F.broadcast(sums) if n_samples <= 100_000 else sums, "sample").withColumn("depth", F.col("depth") * 1e6 / F.col("of_sample"))
    w = Window.partitionBy("contig_idx")
    out = per_million.withColumn("total", F.sum("depth").over(w))
    share = F.when(F.col("total") == 0, F.lit(1.0) / n_samples).otherwise(F.col("depth") / F.col("total"))
    return out.select("contig_idx", "sample", "depth", "total", share.alias("share"))
