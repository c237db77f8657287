"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.graph import components, forest
from sparkmill.llm.shared import materialize

#: Leading principal dimensions of the grid order, and those by which blocks are matched.
ORDER_DIMS, MATCH_DIMS = 6, 2
#: Vectors of a block, and of the smallest interval of the recursion.
BLOCK, LEAF = 4096, 256
#: Slack for rounding where a block pair is skipped or taken whole.
SLACK = 1e-9


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & sound & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest component first, so that squares stay finite."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (mean, axes as columns by falling variance) of unit vectors (columns dim, vec).

    Every task sends its sums as one row for each number, which are added up before dim * (dim + 3) / 2 of them reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = unit(_matrix(b.column(1).filter(pa.array(dims == d)), d))
                s = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
                s[0] += len(x)
                s[1] += x.sum(axis=0)
                s[2] += x.T @ x
        for d, (n, first, second) in sums.items():
            values = np.concatenate([[n], first, second[np.triu_indices(d)]])
            yield pa.record_batch({"dim": pa.array(np.full(len(values), d, np.int32)), "i": pa.array(np.arange(len(values), dtype=np.int64)), "v": pa.array(values)})

    sums = vectors.select("dim", "vec").mapInArrow(moments, "dim int, i long, v double").groupBy("dim", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d in {r.dim for r in sums}:
        v = np.zeros(1 + d + d * (d + 1) // 2)
        for r in sums:
            if r.dim == d:
                v[r.i] = r.v
        mean, second = v[1 : d + 1] / v[0], np.zeros((d, d))
        second[np.triu_indices(d)] = v[d + 1 :] / v[0]
        second = second + second.T - np.diag(np.diag(second))
        _, axes = np.linalg.eigh(second - np.outer(mean, mean))
        out[d] = (mean, np.ascontiguousarray(axes[:, ::-1]))
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Interval:
    """Vectors in grid order with the bounding boxes of their intervals."""

    def __init__(self, x: np.ndarray, n: np.ndarray, axes: np.ndarray) -> None:
        self.x, self.n, self.y, self.boxes = x, n.astype(np.float64), x @ axes, {}

    def box(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        if (s, e) not in self.boxes:
            self.boxes[s, e] = self.y[s:e].min(axis=0), self.y[s:e].max(axis=0)
        return self.boxes[s, e]


def join_intervals(a: Interval, b: Interval, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weighted links of every vector of a and of b, and edges (index in a, index in b) that connect what is linked.

    Sequence intervals are halved and joined recursively. A pair of intervals whose boxes are provably further apart than
    the threshold is skipped; one whose boxes lie provably within it is linked whole without comparing. a is b: each pair once.
    """
    count_a, count_b, edges = np.zeros(len(a.n)), np.zeros(len(b.n)), []
    same, far = a is b, 2 - 2 * least

    def walk(s: int, e: int, u: int, v: int) -> None:
        if same and u < s:
            return
        (low, high), (left, right) = a.box(s, e), b.box(u, v)
        gap = np.maximum(0, np.maximum(low - right, left - high))
        if gap @ gap > far + SLACK:
            return
        diagonal = same and (s, e) == (u, v)
        reach = np.maximum(high - left, right - low)
        if reach @ reach < far - SLACK:
            if diagonal:
                count_a[s:e] += a.n[s:e].sum() - a.n[s:e]
            else:
                count_a[s:e] += b.n[u:v].sum()
                count_b[u:v] += a.n[s:e].sum()
            edges.append((np.arange(s, e), np.full(e - s, u)))
            edges.append((np.full(v - u, s), np.arange(u, v)))
            return
        if e - s <= LEAF and v - u <= LEAF:
            near = a.x[s:e] @ b.x[u:v].T >= least
            if diagonal:
                np.fill_diagonal(near, False)
            p, q = np.nonzero(near)
            if not len(p):
                return
            weight = near.astype(np.float64)
            count_a[s:e] += weight @ b.n[u:v]
            if not diagonal:
                count_b[u:v] += a.n[s:e] @ weight
            if len(p) > 4 * (e - s + v - u):
                node, root = forest(p, q + (e - s))  # the columns' numbers follow the rows'
                both = [np.concatenate([p[:0], x]) for x in (node, root)]
                edges.append((both[0], both[1], s, e, u))
            else:
                edges.append((p + s, q + u))
            return
        m, w = (s + e) // 2, (u + v) // 2
        if diagonal:
            walk(s, m, s, m)
            walk(s, m, m, e)
            walk(m, e, m, e)
        elif e - s >= v - u:
            walk(s, m, u, v)
            walk(m, e, u, v)
        else:
            walk(s, e, u, w)
            walk(s, e, w, v)

    if len(a.n) and len(b.n):
        walk(0, len(a.n), 0, len(b.n))
    return count_a, count_b, edges


def _global_edges(edges: list[tuple], ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    us, vs = [ids_a[:0]], [ids_a[:0]]
    for x in edges:
        if len(x) == 2:
            us.append(ids_a[x[0]])
            vs.append(ids_b[x[1]])
        else:
            p, q, s, e, u = x
            pick = lambda k, s=s, e=e, u=u: np.where(k < e - s, ids_a[np.minimum(k + s, len(ids_a) - 1)], ids_b[np.clip(k - (e - s) + u, 0, len(ids_b) - 1)])
            us.append(pick(p))
            vs.append(pick(q))
    return np.concatenate(us), np.concatenate(vs)


def embedding_links(classes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(node, links, root): for vectors (cid, dim, n, vec) of distinct values, weighted links found and stars that connect them.

    Vectors are sorted by their grid cells on leading principal dimensions and cut into blocks; blocks whose boxes, widened
    by the threshold distance, share a cell of the first MATCH_DIMS dimensions and whose boxes are near enough are joined,
    one pair of blocks a group.
    """
    eps = float(np.sqrt(max(2 - 2 * least, 1e-12)))
    axes = principal_axes(classes)
    shared = classes.sparkSession.sparkContext.broadcast(axes)  # dim x dim numbers for each dimension

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                y = unit(_matrix(part.column(3), d)) @ shared.value[d][1][:, :ORDER_DIMS]
                cell = np.zeros((len(y), ORDER_DIMS), np.int32)
                cell[:, : y.shape[1]] = np.floor(y / eps)
                yield pa.record_batch([*part.columns, *[pa.array(cell[:, j]) for j in range(ORDER_DIMS)]], names=["cid", "dim", "n", "vec", *grid])

    grid = [f"g{j}" for j in range(ORDER_DIMS)]
    kind = dict(classes.dtypes)["vec"]
    placed = classes.select("cid", "dim", "n", "vec").mapInArrow(cells, f"cid long, dim int, n long, vec {kind}, " + ", ".join(f"{g} int" for g in grid))
    parts = max(1, -(-classes.count() // (4 * block)))
    ordered = placed.repartitionByRange(parts, "dim", *grid, "cid").sortWithinPartitions("dim", *grid, "cid")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(rows: pa.Table) -> pa.RecordBatch:
            d = rows["dim"][0].as_py()
            x = _matrix(rows["vec"].combine_chunks(), d)
            y = unit(x) @ shared.value[d][1]
            fill = lambda v: np.pad(v, (0, max(0, MATCH_DIMS - d)))
            return pa.record_batch([pa.array([d], pa.int32()), pa.array([x.dtype.str]), *[pa.array([v.tobytes()], pa.binary()) for v in (rows["cid"].to_numpy(), rows["n"].to_numpy(), x)], *[pa.array([fill(v)], pa.list_(pa.float64())) for v in (y.min(axis=0), y.max(axis=0))]], names=["dim", "kind", "cids", "ns", "data", "low", "high"])

        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            while len(table):
                same = int(np.searchsorted(table["dim"].to_numpy(), table["dim"][0].as_py(), "right"))
                if same == len(table) and len(table) < block:
                    break
                yield cut(table.slice(0, min(same, block)).combine_chunks())
                table = table.slice(min(same, block))
            held = table.to_batches()
        if held:
            yield cut(pa.Table.from_batches(held))

    found = ordered.mapInArrow(blocks, "dim int, kind string, cids binary, ns binary, data binary, low array<double>, high array<double>")
    found = materialize(found.withColumn("block", F.monotonically_increasing_id()), "blocks")
    boxes = found.select("block", "dim", "low", "high")
    for j in range(MATCH_DIMS):
        span = F.sequence(F.floor((F.get("low", F.lit(j)) - eps / 2 - SLACK) / eps), F.floor((F.get("high", F.lit(j)) + eps / 2 + SLACK) / eps))
        boxes = boxes.select("*", F.explode(span).alias(f"k{j}"), F.array_min(span).alias(f"m{j}"))
    other = boxes.select(*[F.col(c).alias(f"o_{c}") for c in boxes.columns])
    keys = [boxes[k] == other[f"o_{k}"] for k in ("dim", *[f"k{j}" for j in range(MATCH_DIMS)])]
    pairs = boxes.join(other, keys).where("block <= o_block")
    for j in range(MATCH_DIMS):  # a pair is made in the first cell that both have
        pairs = pairs.where(F.col(f"k{j}") == F.greatest(f"m{j}", f"o_m{j}"))
    gap = F.zip_with(F.zip_with("low", "o_high", lambda x, y: x - y), F.zip_with("o_low", "high", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    pairs = pairs.where(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + SLACK)
    sides = pairs.select(F.col("block").alias("p"), F.col("o_block").alias("q")).select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    sides = sides.join(found.select("block", "dim", "kind", "cids", "ns", "data"), "block")

    def link(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        sides = []
        for r in rows:
            x = np.frombuffer(r["data"], r["kind"]).reshape(-1, r["dim"])
            sides.append((np.frombuffer(r["cids"], np.int64), Interval(unit(x), np.frombuffer(r["ns"], np.int64), shared.value[r["dim"]][1])))
        (ids_a, a), (ids_b, b) = sides[0], sides[-1]
        count_a, count_b, edges = join_intervals(a, b, least)
        u, v = _global_edges(edges, ids_a, ids_b)
        node, root = forest(u, v) if len(u) else (u, v)
        ids = np.concatenate([ids_a, ids_b])
        counts = np.concatenate([count_a, count_b]).astype(np.int64)
        hit = np.flatnonzero(counts)
        return pa.table({"node": np.concatenate([ids[hit], node]), "links": np.concatenate([counts[hit], np.zeros(len(node), np.int64)]), "root": np.concatenate([ids[hit], root])})

    return sides.groupBy("p", "q").applyInArrow(link, "node long, links long, root long")


def near_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """id, links (other vectors of cosine >= least, in double precision), component (smallest id reachable), per row.

    Equal vectors are one class and are never paired. Null, zero and non-finite vectors, and vectors of different length,
    do not link: links 0, a component of their own. Repeated rows are vectors of their own; a null id names no component.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    good = base.where(usable(F.col("vec")))
    classes = good.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("vec").alias("dim"), "n", "first", "vec"), "vectors")
    found = materialize(embedding_links(classes, least, block), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.join(counts, F.col("cid") == F.col("node"), "left").drop("node").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = materialize(named.select("cid", "first", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "cid").alias("root")), "rooted")
    least_id = materialize(named.groupBy("root").agg(F.min("first").alias("component")), "names")  # a stored side: a large component's join can be split
    named = materialize(named.join(least_id, "root").select(F.col("vec").alias("v"), "links", "component"), "classes")
    out = good.join(named, F.col("vec") == F.col("v")).select("id", "links", "component")
    out = out.unionByName(base.where(~usable(F.col("vec"))).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.withColumnRenamed("id", id_col)
