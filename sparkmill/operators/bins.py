"""Clusters and bins: splitting by sample, sizes, overlaps, dereplication and ripping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.functions.names import bin_name, rest_of, sample_of, splits
from sparkmill.sources.scratch import Scratch, stored


def split_by_sample(members: DataFrame, sep: str) -> DataFrame:
    """(cluster, name) with the cluster split to {sample}{sep}{cluster}; a name that does not split is an error."""
    ok = F.when(splits(F.col("name"), sep), sample_of(F.col("name"), sep)).otherwise(F.raise_error(F.concat(F.lit("no sample in "), "name")).cast("string"))
    return members.select(bin_name(ok, sep, F.col("cluster").cast("string")).alias("bin"), "name")


def unsplittable(names: DataFrame, sep: str) -> DataFrame:
    """One row: how many names do not split. A default separator is dropped if there is any, a given one is an error."""
    return names.agg(F.count_if(~splits(F.col("name"), sep)).alias("n_bad"), F.count(F.lit(1)).alias("n"))


def sizes(members: DataFrame, lengths: DataFrame, key: str = "cluster", contig: str = "contig_idx") -> DataFrame:
    """(cluster, bp, n_contigs)."""
    return members.join(lengths, contig).groupBy(key).agg(F.sum(F.col("length").cast("long")).alias("bp"), F.count(F.lit(1)).alias("n_contigs"))


def at_least_bases(members: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """Members of the clusters of at least so many bases."""
    return members.join(sizes(members, lengths).where(F.col("bp") >= least).select("cluster"), "cluster", "left_semi")


def at_least_members(members: DataFrame, least: int) -> DataFrame:
    """Distinct members of the clusters that have at least so many."""
    once = members.select("cluster", "contig_idx").distinct()
    return once.join(once.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "cluster", "left_semi")


def unknown_contigs(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """Names of members that no contig has."""
    return members.join(contigs, "name", "left_anti").select("name").distinct()


def known(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """members (name, ...) with the contig_idx of their contigs; a name that no contig has is a ValueError."""
    odd = unknown_contigs(members, contigs).limit(1).collect()
    if odd:
        raise ValueError(f"no contig has the name {odd[0]['name']}")
    return members.join(contigs.select("name", "contig_idx"), "name")


def overlaps(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, shared_bp, weight) of bins that share contigs, a < b; weight: shared bases over those of the smaller bin.

    A self-join on the contig: bins that share nothing never meet.
    """
    m = members.select("bin", "contig_idx").distinct()
    bp = m.join(lengths, "contig_idx").groupBy("bin").agg(F.sum(F.col("length").cast("long")).alias("bp"))
    pairs = m.withColumnRenamed("bin", "a").join(m.withColumnRenamed("bin", "b"), "contig_idx").where("a < b")
    shared = pairs.join(lengths, "contig_idx").groupBy("a", "b").agg(F.sum(F.col("length").cast("long")).alias("shared_bp"))
    out = shared.join(bp.select(F.col("bin").alias("a"), F.col("bp").alias("bp_a")), "a").join(bp.select(F.col("bin").alias("b"), F.col("bp").alias("bp_b")), "b")
    return out.select("a", "b", "shared_bp", (F.col("shared_bp") / F.least("bp_a", "bp_b")).alias("weight"))


def score(completeness: str = "completeness", contamination: str = "contamination"):
    return F.col(completeness) - 5 * F.col(contamination)


def worse_better(pairs: DataFrame, quality: DataFrame) -> DataFrame:
    """pairs as (worse, better, ...): by completeness - 5 contamination, of equal ones a is worse."""
    s = quality.select(F.col("bin").alias("k"), score().alias("s"))
    scored = pairs.join(s.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    swap = F.col("sa") > F.col("sb")
    return scored.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("worse"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("better"), "shared_bp", "weight", F.least("sa", "sb").alias("worse_score"))


#: So few undecided pairs are finished by one task, or one for each component.
ONE_TASK_PAIRS = 200_000


def _first_of_bins(left: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Rows of `left` (a, b, key) that no earlier row touches at either bin; no two of them touch."""
    least = left.select(F.explode(F.array(a, b)).alias("bin"), "key").groupBy("bin").agg(F.min("key").alias("least"))
    least = scratch.keep(least)  # joined by a shuffle, so that a bin of many pairs can be split
    one = left.join(least.select(F.col("bin").alias(a), F.col("least").alias("least_a")), a).where("key = least_a")
    return one.join(least.select(F.col("bin").alias(b), F.col("least").alias("least_b")), b).where("key = least_b").drop("least_a", "least_b")


def dereplicated(pairs: DataFrame, least: float = 0.75, one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    """(bin): the worse bins of pairs (worse, better, weight, worse_score) that go.

    Pairs of at least the given weight are taken by rising score of the worse bin, then by names; a pair of which a bin is
    already gone is skipped. It is done in rounds: a pair that is before all undecided pairs of its two bins is decided,
    its worse bin goes, and with it all other pairs of that bin, which is what going through them in order gives. Few
    undecided pairs are finished by one task.
    """
    import pandas as pd

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for r in rows.sort_values(["worse_score", "worse", "better"]).itertuples():
            if r.worse not in gone and r.better not in gone:
                gone[r.worse] = True
        return pd.DataFrame({"bin": [*gone]}, dtype=object)

    spark, kind, last = pairs.sparkSession, dict(pairs.dtypes)["worse"], Scratch(pairs.sparkSession)
    left = last.keep(pairs.where(F.col("weight") >= least).select("worse", "better", "worse_score", F.struct("worse_score", "worse", "better").alias("key")))
    found = left.select(F.col("worse").alias("bin")).limit(0)
    while left.count() > one_task_pairs:
        way, new = Scratch(spark), Scratch(spark)
        gone = stored(_first_of_bins(left, "worse", "better", way).select(F.col("worse").alias("bin")).distinct())
        found = found.unionByName(gone)
        left = new.keep(left.join(gone.withColumnRenamed("bin", "worse"), "worse", "left_anti").join(gone.withColumnRenamed("bin", "better"), "better", "left_anti").select(left.columns))
        way.clear()
        last.clear()
        last = new
    if one_task_pairs:
        found = found.unionByName(left.drop("key").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(greedy, f"bin {kind}"))
    return found


def ripped(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(bin, contig_idx): for pairs (a, b) both bins without what they share, named a--b and b--a."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    own = members.select(F.col("bin").alias("a"), "contig_idx").distinct().join(both, "a")
    other = members.select(F.col("bin").alias("b"), "contig_idx").distinct()
    return own.join(other, ["b", "contig_idx"], "left_anti").select(F.concat_ws("--", F.col("a").cast("string"), F.col("b").cast("string")).alias("bin"), "contig_idx")


def weak_edges_cut(members: DataFrame, pairs: DataFrame, sizes_by_bin: DataFrame, most: float = 0.001) -> DataFrame:
    """members without the shared contigs of two-bin components whose weight is at most `most`, taken from the larger bin (of equal ones b)."""
    bp = sizes_by_bin.select(F.col("bin").alias("k"), "bp")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("bin")).groupBy("bin").count().where("count = 1").select("bin")
    lone = pairs.where(F.col("weight") <= most).join(degree.withColumnRenamed("bin", "a"), "a", "left_semi").join(degree.withColumnRenamed("bin", "b"), "b", "left_semi")
    side = lone.join(bp.select(F.col("k").alias("a"), F.col("bp").alias("bp_a")), "a").join(bp.select(F.col("k").alias("b"), F.col("bp").alias("bp_b")), "b")
    larger = side.select(F.when(F.col("bp_a") > F.col("bp_b"), F.col("a")).otherwise(F.col("b")).alias("bin"), F.when(F.col("bp_a") > F.col("bp_b"), F.col("b")).otherwise(F.col("a")).alias("smaller"))
    shared = larger.join(members, "bin").join(members.select(F.col("bin").alias("smaller"), "contig_idx"), ["smaller", "contig_idx"]).select("bin", "contig_idx")
    return members.join(shared, ["bin", "contig_idx"], "left_anti")


def _edge() -> Column:
    """The order in which edges are cut: by weight, then by names."""
    return F.struct("weight", "a", "b")


def cut_order(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, weight, component) with `cut`: whether the edge goes where the weakest edges are cut until no part of a component has over two bins.

    What is left of a component has parts of two at most as soon as no bin has two edges. So the last edge to go is the
    strongest among the second strongest ones of its bins, and all weaker ones go before it.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("bin"), "component", _edge().alias("edge"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("edge")))
    second = ends.withColumn("place", place).where("place = 2")
    last = second.groupBy("component").agg(F.max("edge").alias("last"))
    return pairs.join(last, "component", "left").withColumn("cut", F.coalesce(_edge() <= F.col("last"), F.lit(False))).drop("last")


def pairs_only(pairs: DataFrame) -> DataFrame:
    """The edges (a, b, weight) of pairs (a, b, weight, component) that remain once the weakest are cut until no part has over two bins."""
    return cut_order(pairs).where(~F.col("cut")).select("a", "b", "weight")


def cut_shared(members: DataFrame, lengths: DataFrame, cuts: DataFrame, one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    """members (bin, contig_idx) after the cuts (a, b, weight, component) were made by rising weight, then by names.

    A cut takes the contigs that both bins still have out of the one that is longer by then (of equal ones b). Contigs of
    the same bins are taken together. It is done in rounds: cuts that are before all other open cuts of their two bins are
    made at once, as they don't touch each other; few open cuts are finished by a task for each component.
    """
    import pandas as pd

    spark, last = members.sparkSession, Scratch(members.sparkSession)
    kind = dict(members.dtypes)["bin"]
    cuts = stored(cuts.select("a", "b", "component", F.struct("weight", "a", "b").alias("key")))
    own = members.select("bin", "contig_idx").distinct()
    touched = own.join(cuts.select(F.explode(F.array("a", "b")).alias("bin")).distinct(), "bin", "left_semi").join(lengths.select("contig_idx", "length"), "contig_idx")
    touched = stored(touched)
    of_contig = stored(touched.groupBy("contig_idx").agg(F.array_sort(F.collect_set("bin")).alias("bins"), F.first("length").cast("long").alias("length")).where(F.size("bins") > 1))
    classes = stored(of_contig.groupBy("bins").agg(F.sum("length").alias("bp")).withColumn("cls", F.monotonically_increasing_id()))
    held = last.keep(classes.select("cls", F.explode("bins").alias("bin"), "bp"))
    sizes_now = last.keep(touched.groupBy("bin").agg(F.sum(F.col("length").cast("long")).alias("bp")))
    left, lost = last.keep(cuts), None
    add = lambda more: more if lost is None else lost.unionByName(more)
    while left.count() > one_task_pairs:
        way, new = Scratch(spark), Scratch(spark)
        ready = way.keep(_first_of_bins(left, "a", "b", way))
        bp = [sizes_now.select(F.col("bin").alias(x), F.col("bp").alias(f"bp_{x}")) for x in "ab"]
        longer = F.col("bp_a") > F.col("bp_b")
        side = ready.join(bp[0], "a").join(bp[1], "b").select(F.when(longer, F.col("a")).otherwise(F.col("b")).alias("bin"), F.when(longer, F.col("b")).otherwise(F.col("a")).alias("other"))
        gone = stored(side.join(held, "bin").join(held.select("cls", F.col("bin").alias("other")), ["cls", "other"]).select("cls", "bin", "bp"))
        lost = add(gone.select("cls", "bin"))
        less = gone.groupBy("bin").agg(F.sum("bp").alias("less"))
        sizes_now = new.keep(sizes_now.join(less, "bin", "left").select("bin", (F.col("bp") - F.coalesce("less", F.lit(0))).alias("bp")))
        held = new.keep(held.join(gone.select("cls", "bin"), ["cls", "bin"], "left_anti").select("cls", "bin", "bp"))
        left = new.keep(left.join(ready.select("a", "b"), ["a", "b"], "left_anti").select(cuts.columns))
        way.clear()
        last.clear()
        last = new
    if one_task_pairs:
        last_part = left.select(F.explode(F.array("a", "b")).alias("bin"), "component").distinct()
        rows = left.select("component", "a", "b", F.col("key.weight").alias("weight"), F.lit(None).cast("long").alias("cls"), F.lit(None).cast("long").alias("bp"))
        blank = [F.lit(None).cast(kind).alias("b"), F.lit(None).cast("double").alias("weight")]
        rows = rows.unionByName(sizes_now.join(last_part, "bin").select("component", F.col("bin").alias("a"), *blank, F.lit(None).cast("long").alias("cls"), "bp"))
        rows = rows.unionByName(held.join(last_part, "bin").select("component", F.col("bin").alias("a"), *blank, "cls", "bp"))

        def walk(group: pd.DataFrame) -> pd.DataFrame:
            edges = group[group["b"].notna()].sort_values(["weight", "a", "b"])
            total = group[group["b"].isna() & group["cls"].isna()].set_index("a")["bp"].to_dict()
            within: dict = {name: {} for name in total}
            for r in group[group["cls"].notna()].itertuples():
                within[r.a][int(r.cls)] = r.bp
            gone = []
            for r in edges.itertuples():
                loser, other = (r.a, r.b) if total[r.a] > total[r.b] else (r.b, r.a)
                for k in within[loser].keys() & within[other].keys():
                    total[loser] -= within[loser].pop(k)
                    gone.append((k, loser))
            return pd.DataFrame(gone, columns=["cls", "bin"])

        lost = add(rows.groupBy("component").applyInPandas(walk, f"cls long, bin {kind}"))
    lost = lost if lost is not None else held.select("cls", "bin").limit(0)
    contigs = lost.join(classes.select("cls", "bins"), "cls").join(of_contig.select("bins", "contig_idx"), "bins").select("bin", "contig_idx")
    return own.join(contigs, ["bin", "contig_idx"], "left_anti")


def keepers(original: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, keeper, drop_a, drop_b): of a ripped pair the bin whose score falls more keeps the shared contigs (of equal ones a)."""
    o, r = original.select(F.col("bin").alias("k"), score().alias("o")), after.select(F.col("bin").alias("n"), score().alias("r"))
    rows = pairs.select("a", "b", F.concat_ws("--", F.col("a").cast("string"), F.col("b").cast("string")).alias("ab"), F.concat_ws("--", F.col("b").cast("string"), F.col("a").cast("string")).alias("ba"))
    for side, name in (("a", "ab"), ("b", "ba")):
        rows = rows.join(o.select(F.col("k").alias(side), F.col("o").alias(f"o_{side}")), side).join(r.select(F.col("n").alias(name), F.col("r").alias(f"r_{side}")), name)
    rows = rows.withColumn("drop_a", F.col("o_a") - F.col("r_a")).withColumn("drop_b", F.col("o_b") - F.col("r_b"))
    return rows.select("a", "b", F.when(F.col("drop_b") > F.col("drop_a"), F.col("b")).otherwise(F.col("a")).alias("keeper"), "drop_a", "drop_b")


def refreshed_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """old quality (bin, completeness, contamination), replaced where new has the bin."""
    n = new.select("bin", F.col("completeness").alias("c1"), F.col("contamination").alias("c2"))
    return old.join(n, "bin", "left").select("bin", F.coalesce("c1", "completeness").alias("completeness"), F.coalesce("c2", "contamination").alias("contamination"))


def cluster_samples(members: DataFrame, sep: str) -> DataFrame:
    """(cluster, sample): the sample of a cluster's first contig by name."""
    return members.groupBy("cluster").agg(F.min("name").alias("n")).select("cluster", sample_of(F.col("n"), sep).alias("sample"))


def ripped_pair(name):
    """(first, second) of a name a--b."""
    return sample_of(name, "--"), rest_of(name, "--")


def without(members: DataFrame, removed: DataFrame) -> DataFrame:
    """members (bin, contig_idx) without the given rows."""
    return members.join(removed.select("bin", "contig_idx"), ["bin", "contig_idx"], "left_anti")


def changed_alone(before: DataFrame, after: DataFrame, lengths: DataFrame) -> DataFrame:
    """(bin): bins that lost contigs and overlap with no other bin any more: those whose score must be found anew."""
    lost = without(before, after).select("bin").distinct()
    still = overlaps(after, lengths).select(F.explode(F.array("a", "b")).alias("bin")).distinct()
    return lost.join(after.select("bin").distinct(), "bin", "left_semi").join(still, "bin", "left_anti")


def pair_scores(ripped_quality: DataFrame) -> DataFrame:
    """(a, b, score_ab, score_ba) of ripped bins a--b and b--a, a < b."""
    first, second = ripped_pair(F.col("bin"))
    rows = ripped_quality.select(first.alias("x"), second.alias("y"), score().alias("s"))
    rows = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("x") < F.col("y")).alias("own"), "s")
    return rows.groupBy("a", "b").agg(F.max(F.when(F.col("own"), F.col("s"))).alias("score_ab"), F.max(F.when(~F.col("own"), F.col("s"))).alias("score_ba"))


def final_bins(members: DataFrame, pairs: DataFrame, original: DataFrame, after: DataFrame, least_completeness: float = 0.9, most_contamination: float = 0.05) -> DataFrame:
    """(bin, contig_idx): of every ripped pair (a, b) the keeper stays whole and the other loses what they share; only near-complete bins stay.

    original and after: quality in percent of whole bins and of ripped ones (a--b, b--a).
    """
    k = keepers(original, after, pairs)
    loser = F.when(F.col("keeper") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    cut = k.select(loser.alias("bin"), "keeper", F.concat_ws("--", loser.cast("string"), F.col("keeper").cast("string")).alias("ripped"))
    shared = cut.join(members, "bin").join(members.select(F.col("bin").alias("keeper"), "contig_idx"), ["keeper", "contig_idx"]).select("bin", "contig_idx")
    new = cut.join(after.withColumnRenamed("bin", "ripped"), "ripped").select("bin", "completeness", "contamination")
    good = refreshed_scores(original, new).where((F.col("completeness") / 100 >= least_completeness) & (F.col("contamination") / 100 <= most_contamination))
    return without(members, shared).join(good.select("bin"), "bin", "left_semi")


def quality_report(members: DataFrame, quality: DataFrame, sep: str) -> DataFrame:
    """(bin, sample, completeness, contamination, n_contigs) of scored bins of named contigs (bin, name)."""
    n = members.groupBy("bin").agg(F.count(F.lit(1)).alias("n_contigs"))
    samples = cluster_samples(members.withColumnRenamed("bin", "cluster"), sep).withColumnRenamed("cluster", "bin")
    return quality.join(samples, "bin").join(n, "bin").select("bin", "sample", "completeness", "contamination", "n_contigs")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """(version, hours, nc) of runs (version, dataset, seconds, nc): of each data set the fastest run and the mean number of near-complete bins, summed up."""
    by = runs.groupBy("version", "dataset").agg(F.min("seconds").alias("seconds"), F.avg("nc").alias("nc"))
    return by.groupBy("version").agg((F.sum("seconds") / 3600).alias("hours"), F.sum("nc").alias("nc"))
