"""Comparing only points that may be near: cells around pivots, and pairs of blocks that no bound keeps apart.

Points are rows of half_unit: half the cosine distance of two is half their squared Euclidean distance. A point belongs to
the cell of its nearest pivot. One that lies further than the radius beyond the plane halfway between its own pivot and another
one has no near point in that other cell. Cells are cut in blocks of bounded size; a task gets what is left of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.sources.scratch import stored

#: Rows of a block at most, on average, for few points and at any number of them; a part of so few rows is one block.
BLOCK_ROWS, MOST_BLOCK_ROWS, TOGETHER = 4_096, 65_536, 256
#: Points for each pivot, and how many pivots there are at least and at most. Blocks grow with the points so that there are hardly
#: more of them than pivots: a row is sent once for every block that it may meet.
PIVOT_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 2_048, 16, 32
#: Directions, spanned by the first pivots, along which pairs are told apart before their distance is worked out.
DIRECTIONS = 16
#: Bounds are widened by so much, as sums of products round.
SLACK = 1e-9
#: Cells of a matrix, and pairs, that a task works through at a time.
CELLS, PAIRS = 1 << 20, 1 << 14
#: Where the bound leaves more than this part of the pairs, whole products are cheaper than one product for each pair.
DENSE = 0.02


def _matrix(lists: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def directions(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the first pivots."""
    return np.linalg.qr(pivots[:DIRECTIONS].T)[0]


def beyond(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and how far the row lies beyond the plane halfway to every pivot."""
    squares = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1), 0)
    own = squares.argmin(axis=1)
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 1e-300))
    return own, (squares - squares[np.arange(len(x)), own][:, None]) / (2 * apart[own])


def near_pairs(x: np.ndarray, y: np.ndarray | None, radius: float, basis: np.ndarray, tried: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of the pairs within the radius; without y pairs of rows of x, each once.

    The distance along the basis and that of what is left of the lengths bound the whole distance from below; it is
    worked out only for pairs that this doesn't exclude. Where it excludes few, all are told apart by a product of the whole
    matrices. tried gets the number of those that are worked out one by one.
    """
    same = y is None
    y = x if same else y
    flat = lambda z: np.concatenate([p := z @ basis, np.sqrt(np.maximum((z * z).sum(axis=1) - (p * p).sum(axis=1), 0))[:, None]], axis=1)
    fx, fy = flat(x), flat(y)
    half = ((fx * fx).sum(axis=1) / 2, (fy * fy).sum(axis=1) / 2)
    step = max(1, CELLS // max(1, len(y)))
    for s in range(0, len(x), step):
        bound = half[0][s : s + step, None] + half[1] - fx[s : s + step] @ fy.T
        left = bound <= radius + SLACK
        if np.count_nonzero(left) > DENSE * left.size:
            left = 0.5 - x[s : s + step] @ y.T <= radius + SLACK
        i, j = np.nonzero(left)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        if tried is not None:
            tried.append(len(i))
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            d = 0.5 - np.einsum("ij,ij->i", x[a], y[b])
            near = d <= radius
            if near.any():
                yield a[near], b[near], d[near]


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j, d) of a minimum spanning forest of n nodes; of equal ones those first by (first, second)."""
    above = np.arange(n)
    taken = np.zeros(0, np.int64)
    rank = np.empty(len(d), np.int64)
    rank[np.lexsort((second, first, d))] = np.arange(len(d))
    left = np.arange(len(d))
    while len(left):  # rounds: every part takes its first edge outwards
        a, b = above[i[left]], above[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        best = np.full(n, len(d), np.int64)
        np.minimum.at(best, a, rank[left])
        np.minimum.at(best, b, rank[left])
        chosen = left[(best[a] == rank[left]) | (best[b] == rank[left])]
        taken = np.concatenate([taken, chosen])
        # every part hangs below the other end of its edge; of two that chose the same edge the smaller one stays on top
        to = np.arange(n)
        ca, cb = above[i[chosen]], above[j[chosen]]
        for own, other in ((ca, cb), (cb, ca)):
            mine = best[own] == rank[chosen]
            to[own[mine]] = other[mine]
        twice = to[to] == np.arange(n)
        to = np.where(twice & (np.arange(n) < to), np.arange(n), to)
        while (to[to] != to).any():
            to = to[to]
        above = to[above]
    return taken


def finite(v: Column) -> Column:
    """Whether a vector is there and all its numbers are."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def count_and_dims(points: DataFrame) -> tuple[int, int]:
    r = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if r["n"] and r["least"] != r["most"]:
        raise ValueError("vectors of different lengths can't be compared")
    return r["n"], r["most"] or 0


def division(n: int) -> tuple[int, int]:
    """How many pivots n points have, and how many rows a block."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, n // PIVOT_ROWS)), min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, 2 * n // MOST_PIVOTS))


def block_pairs(points: DataFrame, radius: float, by: tuple[str, ...] = (), idx: str = "contig_idx", extra: tuple[str, ...] = (), pivots: int | None = None, block_rows: int | None = None, together: int = TOGETHER) -> tuple[DataFrame, np.ndarray]:
    """(part, lo, hi, block, by, id, v, *extra) and a basis of directions: for every pair of blocks lo <= hi that may have near points, the rows of both that may have any.

    Points are compared with those of equal `by` only (nulls are equal). Rows whose vector is null or not finite are left
    out, as they are near nothing. Pivots are the points of smallest hashes, so few that they go to every task.
    """
    spark = points.sparkSession
    part = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = points.where(finite(F.col("v"))).select(part.alias("part"), F.struct(*by, F.lit(0).alias("one")).alias("by"), F.col(idx).alias("id"), "v", *extra)
    n, dims = count_and_dims(rows)
    wanted, rows_of_block = division(n)
    wanted, block_rows = pivots or wanted, block_rows or rows_of_block
    found = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).collect()]
    centres = np.unique(np.round(np.array(found, float).reshape(len(found), dims), 9), axis=0) if found else np.zeros((1, max(1, dims)))
    basis, reach = directions(centres), float(np.sqrt(2 * radius)) + SLACK
    kinds = dict(rows.dtypes)
    names = ["part", "by", "id", "v", *extra]
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 65_536 // max(1, len(centres)))
        for b in batches:
            x = _matrix(b["v"]) if b.num_rows else np.zeros((0, dims))
            cells = [beyond(x[s : s + step], centres)[0].astype(np.int32) for s in range(0, len(x), step)]
            if cells:
                yield pa.record_batch([*b.columns, pa.array(np.concatenate(cells))], names=[*b.schema.names, "cell"])

    celled = stored(rows.mapInArrow(assign, columns + ", cell int"))
    counts = celled.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.struct("cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    parts = stored(counts.groupBy("part").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(blocks)).alias("cells")))  # as many as there are pivots

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, 65_536 // max(1, len(centres)))
            for s in range(0, b.num_rows, step):
                some = b.slice(s, step)
                far = beyond(_matrix(some["v"]), centres)[1] > reach
                at, lo, hi, own = [], [], [], []
                for k, (cell, place, total, cells) in enumerate(zip(*[some[c].to_pylist() for c in ("cell", "place", "total", "cells")])):
                    if total <= together:
                        every, mine = [0], 0
                    else:
                        split = {c["cell"]: c["blocks"] for c in cells}
                        mine = (cell << 32) + place % split[cell]
                        every = [(c << 32) + i for c, n in split.items() if c == cell or not far[k, c] for i in range(n)]
                    at += [k] * len(every)
                    own += [mine] * len(every)
                    lo += [min(mine, x) for x in every]
                    hi += [max(mine, x) for x in every]
                sent = some.select(names).take(pa.array(at, pa.int64()))
                yield pa.record_batch([*sent.columns, *[pa.array(x, pa.int64()) for x in (lo, hi, own)]], names=[*names, "lo", "hi", "block"])

    dealt = celled.join(parts, "part").withColumn("place", F.xxhash64("id").bitwiseAND((1 << 31) - 1))
    return dealt.mapInArrow(deal, columns + ", lo long, hi long, block long"), basis


def compare(points: DataFrame, radius: float, by: tuple[str, ...], idx: str, extra: tuple[str, ...], schema: dict[str, str], work: Callable[[pa.Table, pa.Table | None, Iterator], list], **sizes: int) -> DataFrame:
    """(*by, columns of schema): what `work` makes of every pair of blocks, whose rows come sorted by id; of a block with itself the second is None.

    work gets (x, y, near_pairs of their vectors) and returns the columns.
    """
    rows, basis = block_pairs(points, radius, by, idx, extra, **sizes)
    kinds = dict(points.dtypes)
    struct = ", ".join([f"`{c}`: {kinds[c]}" for c in by] + ["one: int"])
    names = ["by", *schema]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        lo, hi, block = group["lo"][0].as_py(), group["hi"][0].as_py(), group["block"].to_numpy()
        x, y = (group, None) if lo == hi else (group.filter(pa.array(block == lo)), group.filter(pa.array(block == hi)))
        empty = not x.num_rows or y is not None and not y.num_rows
        columns = work(x, y, iter(()) if empty else near_pairs(_matrix(x["v"]), None if y is None else _matrix(y["v"]), radius, basis))
        of = group["by"].combine_chunks().take(pa.array(np.zeros(len(columns[0]), np.int64)))
        return pa.Table.from_arrays([of, *columns], names=names)

    out = rows.groupBy("part", "lo", "hi").applyInArrow(run, ", ".join([f"by struct<{struct}>", *[f"`{c}` {t}" for c, t in schema.items()]]))
    return out.select(*[F.col("by")[c].alias(c) for c in by], *schema)


def _joined(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, t), *c]) for t, c in zip((np.int64, np.int64, float), zip(*found) if found else ((), (), ()))]


def _ends(x: pa.Table, y: pa.Table | None, i: np.ndarray, j: np.ndarray) -> tuple[pa.Array, pa.Array]:
    a, b = x["id"].combine_chunks().take(pa.array(i)), (x if y is None else y)["id"].combine_chunks().take(pa.array(j))
    return pc.min_element_wise(a, b), pc.max_element_wise(a, b)


def near(points: DataFrame, radius: float, by: tuple[str, ...], idx: str, **sizes: int) -> DataFrame:
    """(*by, a, b, distance) of all pairs a < b within the radius."""
    kind = dict(points.dtypes)[idx]

    def work(x: pa.Table, y: pa.Table | None, pairs: Iterator) -> list:
        i, j, d = _joined([*pairs])
        return [*_ends(x, y, i, j), pa.array(d)]

    return compare(points, radius, by, idx, (), {"a": kind, "b": kind, "distance": "double"}, work, **sizes).where("a < b")


def near_sums(points: DataFrame, radius: float, weight: str, by: tuple[str, ...], idx: str, **sizes: int) -> DataFrame:
    """(id, near) of points with others within the radius: the sum of weight * (radius - distance) over these. Each task sums up what it compares."""
    kind = dict(points.dtypes)[idx]

    def work(x: pa.Table, y: pa.Table | None, pairs: Iterator) -> list:
        other = x if y is None else y
        wx, wy = (np.asarray(t[weight].combine_chunks().to_numpy(zero_copy_only=False), float) for t in (x, other))
        sx, sy = np.zeros(len(wx)), np.zeros(len(wy))
        for i, j, d in pairs:
            sx += np.bincount(i, wy[j] * (radius - d), len(sx))
            sy += np.bincount(j, wx[i] * (radius - d), len(sy))
        parts = [(x, sx + sy)] if y is None else [(x, sx), (y, sy)]
        some = [(t["id"].combine_chunks().take(pa.array(np.flatnonzero(s))), s[s != 0]) for t, s in parts]
        return [pa.concat_arrays([ids for ids, _ in some]), pa.array(np.concatenate([s for _, s in some]))]

    sums = compare(points, radius, by, idx, (weight,), {"id": kind, "part_of_sum": "double"}, work, **sizes)
    return sums.groupBy(F.col("id").alias(idx)).agg(F.sum("part_of_sum").alias("near"))


def near_forest(points: DataFrame, radius: float, by: tuple[str, ...], idx: str, **sizes: int) -> DataFrame:
    """(a, b, distance): edges of pairs within the radius that have the components of all such pairs, at this and at every smaller radius.

    Each task hands on a minimum spanning forest of what it compares, fewer edges than it has rows, however many pairs are near.
    """
    kind = dict(points.dtypes)[idx]

    def work(x: pa.Table, y: pa.Table | None, pairs: Iterator) -> list:
        n, shift, held, count = x.num_rows + (0 if y is None else y.num_rows), 0 if y is None else x.num_rows, [], 0

        def reduced() -> list[tuple[np.ndarray, ...]]:
            i, j, d = _joined(held)
            some = np.sort(spanning_forest(n, i, j + shift, d, i, j))
            return [(i[some], j[some], d[some])]

        for found in pairs:
            held.append(found)
            count += len(found[0])
            if count > 4 * n + PAIRS:
                held = reduced()
                count = len(held[0][0])
        i, j, d = reduced()[0] if held else _joined([])
        return [*_ends(x, y, i, j), pa.array(d)]

    return compare(points, radius, by, idx, (), {"a": kind, "b": kind, "distance": "double"}, work, **sizes).where("a < b").select("a", "b", "distance")
