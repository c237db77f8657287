"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.shared import materialize, ranked

#: Up to this many sources are collected and filled on the driver, beyond it by aggregates over their table.
DRIVER_SOURCES = 20_000
#: Up to this many sources are broadcast, beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Up to so many sums of buckets are accumulated by one task.
FEW_SUMS = 1 << 20
#: Bits of the hash that name a bucket, at most, and documents of a bucket, on average, up to there.
BUCKET_BITS, BUCKET_ROWS = 16, 2_000

#: Classes of sizes by powers of two, and how many documents of each class of a source are looked at in a round.
CLASSES, POOL = 48, 4_096
#: Below every hash: no cut.
NO_CUT = -(1 << 63)


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Targets proportional to weights that sum to total, none above max_epochs times its size.

    Every round clamps the sources that would exceed their cap and reshares what they leave among the others by weight,
    until none is above. If every cap is reached the targets sum to less than total.
    """
    targets, free, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if weights[i] > 0], float(total)
    while free:
        per_weight = left / sum(weights[i] for i in free)
        over = [i for i in free if per_weight * weights[i] > max_epochs * sizes[i]]
        if not over:
            for i in free:
                targets[i] = per_weight * weights[i]
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
            left -= targets[i]
        free = sorted(set(free) - set(over))
    return targets


def fill_level(stats: DataFrame, total: float, max_epochs: float) -> float:
    """The level at which the sources' targets least(level * weight, max_epochs * size) sum to total, as water_fill has it.

    stats: (size, weight) for each source, of any number. A round is one aggregate; clamped sources stay clamped, as the
    level only rises. Infinite if every cap is reached.
    """
    level, clamped = 0.0, -1
    cap = F.col("size") * F.lit(float(max_epochs))
    while True:
        over = (F.lit(level) * F.col("weight") > cap) | (F.col("weight") <= 0)
        n, full, free = stats.agg(F.count_if(over), F.coalesce(F.sum(F.when(over & (F.col("weight") > 0), cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == clamped or not free:
            return level if free else float("inf")
        level, clamped = (total - full) / free, n


def targets(stats: DataFrame, weights: Sequence[float], share: float, max_epochs: int, driver_sources: int = DRIVER_SOURCES) -> tuple[DataFrame, int, int]:
    """(of, source_size, target) of stats (source, s, n), the number of sources and the largest n; weights go round in code point order, null last."""
    few = stats.limit(driver_sources + 1).collect()
    if len(few) <= driver_sources:
        few.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["s"] for r in few]
        found = water_fill(sizes, [weights[i % len(weights)] for i in range(len(few))], share * sum(sizes), max_epochs)
        rows = [(r["source"], r["s"], t) for r, t in zip(few, found)]
        return stats.sparkSession.createDataFrame(rows, "of string, source_size long, target double"), len(few), max((r["n"] for r in few), default=0)
    stats, every = materialize(stats, "sources"), F.array(*[F.lit(float(w)) for w in weights])
    own = materialize(ranked(stats, [F.col("source").isNull(), F.col("source")]).select("source", F.col("s").alias("size"), F.get(every, F.col("i") % len(weights)).alias("weight")), "weights")
    n, total = own.agg(F.count(F.lit(1)), F.sum("size")).first()
    level, cap = fill_level(own, share * total, max_epochs), F.col("size") * F.lit(float(max_epochs))
    target = F.when(F.col("weight") > 0, F.least(F.lit(level) * F.col("weight"), cap)).otherwise(0.0)
    return own.select(F.col("source").alias("of"), F.col("size").alias("source_size"), target.alias("target")), n, stats.agg(F.max("n")).first()[0]


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _class(size: Column) -> Column:
    """The power of two at or below a size; null for none."""
    return F.when(size > 0, F.length(F.bin(size)) - 1)


def _extra(u: Column, size: Column) -> Column:
    """Whether a document is taken once more by its source's plan: up to a cut in the hash order, that of its size's class if there is one, or by itself."""
    return F.coalesce((u <= F.greatest(F.get("cuts", _class(size)), F.col("cut_u"))) | F.array_contains("picks", u), F.lit(False))


def _first_cut(sized: DataFrame, plan: DataFrame, n_sources: int, bits: int) -> DataFrame:
    """(of, cut_u, left): of each source whose documents end between two epochs, the longest start of the hash order that fits and the words that this leaves.

    The hash order is cut in buckets whose sums are accumulated; only the bucket in which the remainder ends is looked into.
    """
    few = n_sources <= BROADCAST_SOURCES
    bucket, side = F.shiftright("u", 64 - bits).cast("int"), (lambda df: F.broadcast(df) if few else df)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", "held", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    cut = sums.join(side(plan), F.col("source").eqNullSafe(F.col("of"))).where((F.col("rest") > 0) & (F.col("start") <= F.col("rest")) & (F.col("start") + F.col("held") > F.col("rest")))
    cut = materialize(cut.select("of", F.col("bucket").alias("cut_bucket"), "start", "rest"), "cuts", n_sources << bits <= FEW_SUMS)
    inside = sized.join(side(cut), F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("cut_bucket"))).groupBy("of", "cut_bucket", "start", "rest", "u").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("of").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("end", F.col("start") + F.sum("size").over(order))
    fits = F.col("end") <= F.col("rest")
    last = inside.groupBy("of", "cut_bucket", "start", "rest").agg(F.max(F.when(fits, F.col("u"))).alias("u"), F.max(F.when(fits, F.col("end"))).alias("end"))
    start = F.call_function("shiftleft", F.col("cut_bucket").cast("long"), F.lit(64 - bits))
    return last.select("of", F.coalesce("u", F.when(start > NO_CUT, start - 1).otherwise(start)).alias("cut_u"), (F.col("rest") - F.coalesce("end", "start")).alias("left"))


def _fill_classes(sized: DataFrame, state: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state (of, cut_u, left, cuts) once documents behind the cut have filled what is left, from the longest that fit down to the shortest.

    Sizes are classed by powers of two. Of every class the documents that come first by hash are taken until one doesn't
    fit, so that a class needs one more cut only. A round gets the first `pool` documents of each class of a source; where
    that is not enough, the next round goes on behind them.
    """

    pool = POOL

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, cuts, more = float(rows["left"].iloc[0]), rows["cuts"].iloc[0], False
        cuts = [NO_CUT] * CLASSES if cuts is None else list(cuts)
        for k in sorted(rows["class"].unique(), reverse=True):
            own = rows[rows["class"] == k]
            units = own.groupby("u")["size"].sum().sort_index()  # rows that repeat an id and its text go together
            open_end = len(own) >= pool and len(units) > 1  # then more may follow, and the last one may not be whole
            for u, size in list(units.items())[: len(units) - open_end or None]:
                if size > left:
                    open_end = False
                    break
                left, cuts[k] = left - size, int(u)
            if open_end:
                more = True
                break
        return pd.DataFrame({"of": [key[0]], "left": [left], "cuts": [cuts], "more": [more]})

    while True:
        rows = sized.join(side(state), F.col("source").eqNullSafe(F.col("of"))).where((F.col("left") >= 1) & (F.col("size") > 0) & (_class(F.col("size")) <= _class(F.col("left").cast("long"))) & ~_extra(F.col("u"), F.col("size")))
        rows = rows.select("of", "left", "cuts", "size", "u", _class(F.col("size")).alias("class"))
        place = F.row_number().over(Window.partitionBy("of", "class").orderBy("u"))
        rows = rows.withColumn("place", place).where(F.col("place") <= pool).drop("place")
        new = materialize(rows.groupBy("of").applyInPandas(fill, "of string, left double, cuts array<bigint>, more boolean"), "filled")
        n = new.select(F.col("of").alias("new_of"), F.col("left").alias("new_left"), F.col("cuts").alias("new_cuts"))
        state = state.join(n, F.col("of").eqNullSafe(F.col("new_of")), "left").select("of", "cut_u", F.coalesce("new_left", "left").alias("left"), F.coalesce("new_cuts", "cuts").alias("cuts"), "picks")
        state = materialize(state, "state")
        if not new.where("more").limit(1).count():
            return state


def _pick_nearest(sized: DataFrame, state: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state once the document has been taken by itself that brings each source's words nearest to its target, if one does."""
    rows = sized.join(side(state), F.col("source").eqNullSafe(F.col("of"))).where((F.col("size") > 0) & (F.col("size") < 2 * F.col("left")) & ~_extra(F.col("u"), F.col("size")))
    best = rows.groupBy("of").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "size", "u")).alias("one")).select("of", F.col("one.u").alias("pick"))
    units = sized.join(side(materialize(best, "nearest")), F.col("source").eqNullSafe(F.col("of")) & (F.col("u") == F.col("pick"))).groupBy(F.col("of").alias("pick_of"), "pick").agg(F.sum("size").alias("size"))
    joined = state.join(units, F.col("of").eqNullSafe(F.col("pick_of")), "left")
    better = F.coalesce(F.col("size") < 2 * F.col("left"), F.lit(False))
    return materialize(joined.select("of", "cut_u", F.when(better, F.col("left") - F.col("size")).otherwise(F.col("left")).alias("left"), "cuts", F.when(better, F.array_append("picks", F.col("pick"))).otherwise(F.col("picks")).alias("picks")), "picked")


def _plan(sized: DataFrame, weights: Sequence[float], max_epochs: int, share: float, driver_sources: int) -> DataFrame:
    """Per source: of, source_size, target, whole epochs, and which documents are taken once more (cut_u, cuts, picks); sized: (source, size, u)."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    plan, n_sources, most = targets(stats, weights, share, max_epochs, driver_sources)
    few = n_sources <= BROADCAST_SOURCES
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(max_epochs))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * size)
    bits = min(BUCKET_BITS, max(4, (most // BUCKET_ROWS).bit_length()))
    side = lambda df: F.broadcast(df) if few else df
    first = _first_cut(sized, plan, n_sources, bits)
    state = materialize(first.select("of", "cut_u", "left", F.lit(None).cast("array<bigint>").alias("cuts"), F.array().cast("array<bigint>").alias("picks")), "state", few)
    state = _fill_classes(sized, state, side)
    for _ in range(2):  # what is left is below twice the shortest document, then below half of it
        state = _pick_nearest(sized, state, side)
    state = state.select(F.col("of").alias("cut_of"), "cut_u", "cuts", "picks")
    return side(materialize(plan.join(state, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of", "rest"), "plan", few))


def _repeats(u: Column, size: Column) -> Column:
    return F.col("whole") + _extra(u, size).cast("int")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), _hash(id_col, text_col, seed).alias("u")), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, seed: int = 8, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """Per document: id, source, size (words), source_size, target (of its source), repeats and taken = repeats * size.

    Sources in code point order, null last, take the weights in turn. A source's whole epochs repeat every document; for
    the remaining fraction its documents are taken in the order of a seeded hash of id and text as long as they fit the
    remainder, then shorter ones that still fit, at last the one that comes nearest, so that the words taken miss the
    target by half of the shortest document left at most. A verdict depends on a document's content alone: reruns agree,
    however the rows are split. Null texts have size 0; repeated rows are documents of their own, those of equal id, text
    and source have one verdict. No rows give none; other columns are not read, whatever their names.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    out = sized.join(_plan(sized, weights, max_epochs, share, driver_sources), F.col("source").eqNullSafe(F.col("of"))).withColumn("repeats", _repeats(F.col("u"), F.col("size")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, seed: int = 8, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """The rows of docs as often as mix repeats them, with their columns. Texts are not shuffled: each row is judged where it is read."""
    plan = _plan(_sized(docs, id_col, text_col, source_col, seed), weights, max_epochs, share, driver_sources)
    rows = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("doc_source"), _hash(id_col, text_col, seed).alias("doc_hash"), _size(F.col(text_col)).alias("doc_size"))
    rows = rows.join(plan, F.col("doc_source").eqNullSafe(F.col("of"))).withColumn("doc_repeats", _repeats(F.col("doc_hash"), F.col("doc_size"))).where("doc_repeats > 0")
    return rows.select(F.col("doc"), F.explode(F.sequence(F.lit(1), F.col("doc_repeats")))).select("doc.*")
