"""Connected components of an undirected edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.sources.scratch import Scratch, stored


#: A graph of at most so many edges is finished by one executor task.
ONE_TASK_EDGES = 200_000


def _union(rows: pd.DataFrame) -> pd.DataFrame:
    """Stars (x, y) that join what the edges join, y being the smallest node."""
    above: dict = {}

    def top(v):
        while above.setdefault(v, v) != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    for x, y in zip(rows["x"], rows["y"]):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    nodes = [v for v in above if top(v) != v]
    return pd.DataFrame({"x": nodes, "y": [top(v) for v in nodes]}, dtype=rows["x"].dtype)


def components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node that can be reached. nodes (column node): those to list besides the edges' ends.

    Rounds of large and small stars: every node hands its larger neighbours, then its smaller ones, to the smallest node
    that it knows, until the edges are stars. Edges are written after each round, those of before are deleted; few are finished by one task.
    """
    every = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    every = (every if nodes is None else every.unionByName(nodes.select("node"))).distinct()
    spark, last = edges.sparkSession, Scratch(edges.sparkSession)
    e = last.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    kind = dict(e.dtypes)["x"]
    count = lambda: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
    was, now = None, count()
    while now[0] > one_task_edges and now != was:
        way, new = Scratch(spark), Scratch(spark)
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = way.keep(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = way.keep(both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = way.keep(large.groupBy("x").agg(F.min("y").alias("m")))
        e = new.keep(large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).distinct())
        way.clear()
        last.clear()
        last = new
        was, now = now, count()
    if now != was:
        rest = e.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda rows: _union(rows), f"x {kind}, y {kind}")
        e = stored(rest)
        last.clear()
    return every.join(e, F.col("node") == F.col("x"), "left").select("node", F.coalesce("y", "node").alias("component"))
