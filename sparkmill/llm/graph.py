"""Connected components over edge tables, and a spanning forest of edges held by one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import materialize

#: A contracted graph of at most so many edges (16 bytes each) is finished by one executor task.
ONE_TASK_EDGES = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) stars that connect what the edges a-b connect; the root is the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _finish(edges: pa.Table) -> pa.Table:
    node, root = forest(edges["u"].to_numpy(), edges["v"].to_numpy())
    return pa.table({"u": node, "v": root})


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of edges (u, v: long), root being the smallest node of its component.

    Alternating large-star and small-star rounds contract the graph, each round written to the shared folder; sums by node
    are combined before the shuffle and joins on hub nodes are left to the skew join. Loops and repeated edges are allowed.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    e = materialize(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    size, mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while size > one_task_edges:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), "small-star")
        was, (size, mark) = (size, mark), e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if was == (size, mark):
            return _rooted(e)
    return _rooted(e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_finish, "u long, v long"))


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
