"""Components of the points within a radius, where no bound keeps points apart: nearly all are in one component, or all pairs are told apart by whole products.

Points are rows of half_unit. Products in single precision leave out what is certainly too far; what is left is decided on in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.operators import pivots
from sparkmill.operators.graph import components
from sparkmill.sources.scratch import Scratch, stored

#: Points that every task gets at a time: numbers, and rows at most. Up to FEW points are compared around pivots.
SAMPLE_CELLS, SAMPLE_ROWS, FEW = 1 << 21, 32_768, 8_192
#: Numbers of a block, at most, how many blocks there are at least, and rows and columns of a product that is worked out at a time.
BLOCK_CELLS, LEAST_BLOCKS, TILE = 1 << 22, 8, (512, 1_024)
#: Pivots exclude enough if they leave less than this part of the cells of a row.
SPARSE = 0.25


def near_places(x: np.ndarray, y: np.ndarray, radius: float, x32: np.ndarray | None = None, y32: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of the pairs within the radius, some rows of x at a time."""
    x32, y32 = x.astype(np.float32) if x32 is None else x32, y.astype(np.float32) if y32 is None else y32
    least = np.float32(0.5 - radius - (x.shape[1] + 8) * 2.0**-23)  # by more than a product of rows of half_unit can be off
    for t in range(0, len(y), TILE[1]):
        some = np.ascontiguousarray(y32[t : t + TILE[1]].T)
        for s in range(0, len(x), TILE[0]):
            i, j = np.divmod(np.flatnonzero(x32[s : s + TILE[0]] @ some >= least), some.shape[1])
            for k in range(0, len(i), pivots.PAIRS):
                a, b = i[k : k + pivots.PAIRS] + s, j[k : k + pivots.PAIRS] + t
                d = 0.5 - np.einsum("ij,ij->i", x[a], y[b])
                near = d <= radius
                if near.any():
                    yield a[near], b[near], d[near]


class Forest:
    """Edges that connect what the edges seen so far connect; label: the smallest node of each node's component."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        nodes, at = np.unique(np.concatenate([self.label[i], self.label[j]]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        kept = pivots.spanning_forest(len(nodes), a, b, np.zeros(len(a)), a, b)
        self.edges.append((i[kept], j[kept]))
        low = np.arange(len(nodes))
        while True:  # nodes are sorted: the lowest place is the smallest label
            was = low.copy()
            np.minimum.at(low, a[kept], was[b[kept]])
            np.minimum.at(low, b[kept], was[a[kept]])
            low = low[low]
            if (low == was).all():
                break
        to = np.arange(len(self.label))
        to[nodes] = nodes[low]
        self.label = to[self.label]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(c) for c in zip(*self.edges))


def _held(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of few rows, in the order of ids."""
    table = rows.select("id", "v").toArrow().sort_by("id").combine_chunks()
    return table["id"].to_numpy(), pivots._matrix(table["v"]) if table.num_rows else np.zeros((0, dims))


def _pairwise(rows: DataFrame, radius: float, n: int, dims: int) -> DataFrame:
    """Edges (a, b) that connect what pairs within the radius connect: all pairs are compared, a task for every two blocks."""
    blocks = max(LEAST_BLOCKS, -(-n * max(1, dims) // BLOCK_CELLS))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    sent = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.withColumn("pair", (hi * (hi + 1) / 2 + lo).cast("int")).select("id", "v", "block", F.col("block").eqNullSafe(F.col("other")).alias("within"), "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["id"].to_numpy(), pivots._matrix(b["v"]), b["block"].to_numpy(), b["within"].to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not got:
            return
        ids, x, block, within = (np.concatenate(c) for c in zip(*got))
        del got
        first = block == block.min()
        forest, single = Forest(len(ids)), x.astype(np.float32)
        one, two = (np.arange(len(ids)),) * 2 if within.all() else (np.flatnonzero(first), np.flatnonzero(~first))
        if within.all():
            for s in range(0, len(one), 2_048):  # each pair once, but for those of the same rows
                for i, j, _ in near_places(x[s : s + 2_048], x[s:], radius, single[s : s + 2_048], single[s:]):
                    forest.add(i + s, j + s)
        elif len(one) and len(two) and not within.any():
            for i, j, _ in near_places(x[one], x[two], radius, single[one], single[two]):
                forest.add(one[i], two[j])
        i, j = forest.pairs()
        yield pa.record_batch([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    dealt = sent.repartitionById(blocks * (blocks + 1) // 2, F.col("pair"))
    return dealt.mapInArrow(run, "a long, b long")


def _around(rows: DataFrame, radius: float, n: int, ids: np.ndarray, x: np.ndarray, forest: Forest) -> DataFrame | None:
    """(node, component) of all rows, where most of a sample (ids, x; forest: how it is connected) is in one component; None if that leaves too many rows apart.

    Each row is compared with the sample; rows of the largest component aren't compared with each other, the others are with all.
    """
    label, single = forest.label, x.astype(np.float32)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Forest(len(label))
        for b in batches:
            if not b.num_rows:
                continue
            y, low = pivots._matrix(b["v"]), np.full(b.num_rows, len(label))
            for i, j, _ in near_places(y, x, radius, None, single):
                was = low[i]
                np.minimum.at(low, i, label[j])
                met = was < len(label)
                joined.add(np.concatenate([label[j], was[met]]), np.concatenate([low[i], low[i][met]]))
            yield pa.record_batch([b["id"], b["v"], pa.array(np.where(low < len(label), low, -1)), pa.array(np.full(b.num_rows, -1))], names=["id", "v", "of", "same"])
        i, j = joined.pairs()
        none = pa.nulls(len(i))
        yield pa.record_batch([none.cast(pa.int64()), none.cast(pa.list_(pa.float64())), pa.array(i), pa.array(j)], names=["id", "v", "of", "same"])

    got = (first := Scratch(rows.sparkSession)).keep(rows.mapInArrow(join, "id long, v array<double>, of long, same long"))
    same = got.where("same >= 0").select("of", "same").distinct().toArrow()  # a task joins each component of the sample once at most
    forest.add(same["of"].to_numpy(), same["same"].to_numpy())
    tops = rows.sparkSession.createDataFrame([(int(i), int(t)) for i, t in enumerate(forest.label) if i == label[i]], "of long, top long")
    held = got.where("same < 0").join(F.broadcast(tops), "of", "left").select("id", "v", "top")  # as many as the sample has
    sizes = {r["top"]: (r["n"], r["least"]) for r in held.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).collect()}
    largest = max((t for t in sizes if t is not None), key=lambda t: (sizes[t][0], -t))
    left = n - sizes[largest][0]
    if left > n * SPARSE:
        first.clear()
        return None
    names = rows.sparkSession.createDataFrame([(t, least) for t, (_, least) in sizes.items() if t is not None], "top long, least long")
    held = stored(held.join(F.broadcast(names), "top", "left").select("id", "v", F.coalesce("least", "id").alias("least"), F.coalesce(F.col("top") == largest, F.lit(False)).alias("most")))
    first.clear()
    chunks = max(1, -(-left // max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, x.shape[1])))))
    apart = held.where("not most")
    edges = apart.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    for c in range(chunks):
        own, y = _held(apart.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c), x.shape[1])

        def link(batches: Iterator[pa.RecordBatch], own: np.ndarray = own, y: np.ndarray = y) -> Iterator[pa.RecordBatch]:
            single = y.astype(np.float32)
            for b in batches:
                least, found = b["least"].to_numpy(), []
                if b.num_rows and len(own):
                    found = [np.unique(np.stack([own[j], least[i]]), axis=1) for i, j, _ in near_places(pivots._matrix(b["v"]), y, radius, None, single)]
                pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
                yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        edges = edges.unionByName(stored(held.select("id", "v", "least").mapInArrow(link, "a long, b long")))
    tops = stored(components(stored(edges.where("a <> b").distinct())).select(F.col("node").alias("id"), "component"))
    top = tops.where(F.col("id") == sizes[largest][1]).first()
    found = held.select("id", "least", "most").join(tops, "id", "left")
    return found.select(F.col("id").alias("node"), F.when(F.col("most"), F.lit(top["component"] if top else sizes[largest][1])).otherwise(F.coalesce("component", "least")).alias("component"))


def components_within(points: DataFrame, radius: float, idx: str = "contig_idx", few: int = FEW) -> DataFrame:
    """(node, component) of normalised points (idx: long, v) that pairs within the radius connect: the smallest node that can be reached. Rows without a finite vector are by themselves."""
    nodes = points.select(F.col(idx).alias("node"))
    rows = points.where(pivots.finite(F.col("v"))).select(F.col(idx).alias("id"), "v")
    n, dims = pivots.count_and_dims(rows)
    if n <= few:
        return components(stored(pivots.near_forest(points, radius, (), idx).select("a", "b")), nodes)
    wanted = max(2, min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, dims)))
    ids, x = _held(rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)) < wanted), dims)  # so many, but for chance
    forest, single = Forest(len(ids)), x.astype(np.float32)
    for s in range(0, len(ids), 2_048):
        for i, j, _ in near_places(x[s : s + 2_048], x[s:], radius, single[s : s + 2_048], single[s:]):
            forest.add(i + s, j + s)
    if len(ids) and np.bincount(forest.label).max() > len(ids) / 2:
        found = _around(rows, radius, n, ids, x, forest)
        if found is not None:
            return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    few_x = x[: 64 * pivots.LEAST_PIVOTS]
    centres = few_x[: pivots.division(n)[0]]
    left = np.mean(pivots.beyond(few_x, centres)[1] <= np.sqrt(2 * radius)) if len(few_x) else 0
    edges = pivots.near_forest(points, radius, (), idx).select("a", "b") if left < SPARSE else _pairwise(rows, radius, n, dims)
    return components(stored(edges), nodes)
