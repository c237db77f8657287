"""Clustering whole-number vectors around centroids by Yinyang grouping: bounds by group of centroids spare most distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import delete_table, write_table

#: What components are multiplied with before they are rounded down.
SCALE = 1024
#: Whole numbers beyond this, either way, would not give exact distances in 64 bits.
MOST = 1 << 26
#: By so much bounds are widened at every step, so that rounding never makes one wrong.
SLACK = 1e-9


def whole(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(v: Column, dims: int) -> Column:
    """Whether a vector has exactly so many components, none null or not finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & fine, F.lit(False))


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of plain k-means over the centroids themselves, started evenly spread."""
    x, n = centroids.astype(float), min(groups, len(centroids))
    middle = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(5):
        of = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([x[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(n)])
    return of


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows from a centroid."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def scan_all(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones), an upper bound of its distance, and a lower bound for every group's other centroids."""
    each = np.stack([squared(x, c) for c in centroids], axis=1)
    best = each.argmin(axis=1)
    row = np.arange(len(x))
    upper = np.sqrt(each[row, best].astype(float)) * (1 + SLACK)
    each = np.sqrt(each.astype(float)) * (1 - SLACK)
    each[row, best] = np.inf
    lower = np.stack([each[:, group == g].min(axis=1, initial=np.inf) for g in range(group.max() + 1)], axis=1)
    return best.astype(np.int32), upper, lower


def moved_on(x: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as scan_all after the centroids have moved by `drift`, from the bounds of before.

    A row whose upper bound is below all lower bounds keeps its centroid, first with the old upper bound, then with the
    exact distance. Of the others, only groups whose lower bound is not above that are looked into, and there only the
    centroids that the group's old bound and their own drift don't exclude are scanned.
    """
    n_groups = group.max() + 1
    most = np.array([drift[group == g].max(initial=0.0) for g in range(n_groups)]) * (1 + SLACK)
    best, old = best.copy(), lower * (1 - SLACK)
    upper = (upper + drift[best]) * (1 + SLACK)
    lower = old - most
    rows = np.flatnonzero(upper >= lower.min(axis=1))
    if len(rows):
        own = np.empty(len(rows), np.int64)
        for c in np.unique(best[rows]):
            at = best[rows] == c
            own[at] = squared(x[rows[at]], centroids[c])
        upper[rows] = np.sqrt(own.astype(float)) * (1 + SLACK)
        left = upper[rows] >= lower[rows].min(axis=1)
        rows, own = rows[left], own[left]
    if not len(rows):
        return best, upper, lower
    was, now, near = best[rows].copy(), best[rows].copy(), own.copy()
    look = lower[rows] <= upper[rows, None]  # groups that are not excluded
    reach = upper[rows].copy()
    # bounds of each group's centroids other than the row's final one: the least and the next, as the least may be that
    least = np.where(look, np.inf, lower[rows])
    second, holder = least.copy(), np.full(least.shape, -1)
    mine = np.arange(len(rows))
    for c in range(len(centroids)):
        g = group[c]
        asked = look[:, g] & (was != c)
        bound = old[rows, g] - drift[c] * (1 + SLACK)
        scan = np.flatnonzero(asked & (bound <= reach))
        bound[~asked] = np.inf
        bound[was == c] = np.sqrt(own[was == c].astype(float)) * (1 - SLACK)
        if len(scan):
            exact = squared(x[rows[scan]], centroids[c])
            bound[scan] = np.sqrt(exact.astype(float)) * (1 - SLACK)
            closer = (exact < near[scan]) | ((exact == near[scan]) & (c < now[scan]))
            hit = scan[closer]
            near[hit], now[hit] = exact[closer], c
            reach[hit] = np.sqrt(near[hit].astype(float)) * (1 + SLACK)
        lower_one = bound < least[:, g]
        second[:, g] = np.where(lower_one, least[:, g], np.minimum(second[:, g], bound))
        holder[lower_one, g] = c
        least[lower_one, g] = bound[lower_one]
    final = group[now]
    taken = holder[mine, final] == now
    least[mine[taken], final[taken]] = second[mine[taken], final[taken]]
    best[rows], upper[rows], lower[rows] = now, reach, least
    return best, upper, lower


def _matrix(lists: pa.ListArray, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)), pa.array(rows.ravel()))


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What rows that changed their centroid add to and take from the centroids' counts and sums: summed in each task, then by centroid and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = _matrix(b["v"], np.int64)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = b[name].to_numpy()
                for c in range(k):
                    held[c] += sign * x[at == c].sum(axis=0)
        c, d = np.nonzero(held)
        yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(held[c, d])], names=["c", "d", "n"])

    parts = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "c int, d int, n long")
    out = np.zeros((k, dims + 1), np.int64)
    for r in parts.groupBy("c", "d").agg(F.sum("n").alias("n")).collect():  # a number for each centroid and component
        out[r["c"], r["d"]] = r["n"]
    return out[:, :dims], out[:, dims]


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, groups: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per vector of exactly `dims` finite components: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). The first centroids are the k vectors whose seeded hash of the id is smallest (of
    equal ids the smaller vector first); every round assigns all vectors to the nearest centroid (of equal ones the
    smaller number), then moves every centroid that has some to the exact floor of their mean; at the end all are assigned
    once more. The centroids are put in groups once (`groups`, by default about a third of k); a vector carries an upper bound
    for its centroid and one lower bound a group, see moved_on. Once no centroid moves, further rounds change nothing and
    are left out.

    A round reads one table of vectors and bounds and writes the next; sums are taken of the changed rows alone, in each
    task; only centroids and their sums, of which the number is k, are on the driver. Other vectors are left out, repeated
    rows are vectors of their own, a null id hashes as the empty one; without vectors the result is empty. With fewer than
    k there are fewer centroids. A whole number beyond 2^26 is an error, as its distances exceed 64 bits. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vec_col), dims)).select(F.col(id_col).alias("id"), whole(F.col(vec_col), scale).alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) <= MOST)
    rows = rows.select("id", F.when(fits, F.transform("v", lambda x: x.cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).alias("v"))
    kind = dict(rows.dtypes)["id"]
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    result = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        return spark.createDataFrame([], result)
    k = len(first)
    group = grouped(centroids, groups or -(-k // 3))
    schema = f"id {kind}, v array<int>, cluster int, was int, upper double, lower array<double>"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, upper, lower = scan_all(_matrix(b["v"], np.int64), centroids, group)
            yield pa.record_batch([b["id"], b["v"], pa.array(best), pa.array(np.full(len(best), -1, np.int32)), pa.array(upper), _lists(lower)], names=["id", "v", "cluster", "was", "upper", "lower"])

    def step(centroids: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                was = b["cluster"].to_numpy()
                best, upper, lower = moved_on(_matrix(b["v"], np.int64), was, b["upper"].to_numpy(), _matrix(b["lower"], float), centroids, group, drift)
                yield pa.record_batch([b["id"], b["v"], pa.array(best), pa.array(was), pa.array(upper), _lists(lower)], names=["id", "v", "cluster", "was", "upper", "lower"])

        return run

    read = lambda path: spark.read.schema(schema).parquet(path)
    path = write_table(rows.mapInArrow(start, schema), "assigned")
    sums, counts = np.zeros_like(centroids), np.zeros(k, np.int64)
    for _ in range(rounds):
        more, n = _sums(read(path), k, dims)
        sums, counts = sums + more, counts + n
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        if (new == centroids).all():
            break
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        centroids, before = new, path
        path = write_table(read(before).mapInArrow(step(centroids, drift), schema), "assigned")
        delete_table(spark, before)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, of = _matrix(b["v"], np.int64), b["cluster"].to_numpy()
            d = np.empty(len(of), np.int64)
            for c in np.unique(of):
                d[of == c] = squared(x[of == c], centroids[c])
            yield pa.record_batch([b["id"], b["cluster"], pa.array(d)], names=["id", "cluster", "distance"])

    found = read(path).select("id", "v", "cluster").mapInArrow(distances, f"id {kind}, cluster int, distance long")
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(k)])
    return found.select(F.col("id").alias(id_col), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(F.array(*map(F.lit, digest)), F.col("cluster")).alias("centroid_sha256"))
