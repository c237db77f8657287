"""Training over all rows of a table: epochs on shards in tasks, whose weights are averaged."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.models.vae import Inputs
from sparkmill.sources.scratch import Scratch

#: Rows of a shard, on average: what a task holds.
SHARD_ROWS = 50_000
#: So many shards' weights are added up by one task, and at most so many sums come to the driver.
TOGETHER = 16


def flat(model: Any, steps: list) -> np.ndarray:
    """Weights, running statistics and the optimisers' state as one vector."""
    return np.concatenate([np.asarray(a, np.float64).ravel() for a in [*model.state(), *[a for s in steps for a in s.state()]]])


def unflat(model: Any, steps: list, values: np.ndarray) -> None:
    """Put such a vector back."""
    at = 0
    for holder in (model, *steps):
        given = []
        for a in holder.state():
            given.append(values[at : at + np.size(a)].reshape(np.shape(a)))
            at += np.size(a)
        holder.load(given)


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), np.float64) for v in group["sums"])
    return pa.table({"shard": group["shard"].slice(0, 1), "n": [sum(group["n"].to_pylist())], "loss": [np.sum(group["loss"].to_pylist(), axis=0).tolist()], "sums": [total.tobytes()]}).cast(group.schema)


def _epochs(shared: Broadcast, seed: int, plan: list[tuple[int, int]]) -> Callable[[pa.Table], pa.Table]:
    """From the common weights through some epochs (number, batch) of a shard: its weights times its rows, and its losses."""

    def run(group: pa.Table) -> pa.Table:
        model, steps = shared.value
        before, shard = flat(model, steps), group["shard"][0].as_py()
        x, losses = Inputs.of(group.sort_by("contig_idx")), []
        for epoch, batch in plan:
            model.reseed([seed, epoch, shard])
            losses.append(float(np.mean(model.epoch(x, x.labels, batch, steps))) * len(x))
        sums = len(x) * flat(model, steps)
        unflat(model, steps, before)  # the worker's copy serves other shards too
        kinds = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("loss", pa.list_(pa.float64())), ("sums", pa.binary())])
        return pa.table({"shard": [shard], "n": [len(x)], "loss": [losses], "sums": [sums.tobytes()]}, schema=kinds)

    return run


def train_frame(model: Any, features: DataFrame, epochs: int, batch: int, double_at: tuple[int, ...] = (), lr: float | None = None, seed: int = 0, shard_rows: int = SHARD_ROWS) -> list[float]:
    """Train the model on all rows of features(contig_idx, depths, tnf, total_ab, weight and maybe label); the loss of every epoch.

    Rows are dealt by a hash of contig_idx to shards, whose number depends on the number of rows alone. In every epoch a
    task takes the common weights and the optimiser's state through the minibatches of a shard; the results, weighted by
    rows, are averaged: added up by tasks in groups, so that the driver gets a few vectors as long as the weights. How many
    tasks there are changes nothing, and up to shard_rows rows it is training without shards.
    """
    spark, more = features.sparkSession, ["label"] * ("label" in features.columns)
    n = features.count()
    if n < 2:
        raise ValueError("at least two contigs are needed")
    shards = -(-n // shard_rows)
    table = Scratch(spark)
    rows = table.keep(features.select(F.col("contig_idx").cast("long"), "depths", "tnf", "total_ab", "weight", *more, F.pmod(F.xxhash64("contig_idx"), F.lit(shards)).cast("int").alias("shard")))
    steps, losses = model.steps(lr), []
    plans = []
    for epoch in range(epochs):
        batch *= 1 + (epoch in double_at)
        plans.append((epoch, batch))
    plans = [plans] if shards == 1 else [[p] for p in plans]  # one shard has nothing to average
    for plan in plans:
        shared = spark.sparkContext.broadcast((model, steps))
        kinds, step = "shard int, n long, loss array<double>, sums binary", Scratch(spark)
        parts = step.keep(rows.groupBy("shard").applyInArrow(_epochs(shared, seed, plan), kinds))
        left = shards
        while left > TOGETHER:
            left = -(-left // TOGETHER)
            parts = step.keep(parts.withColumn("shard", F.col("shard") % left).groupBy("shard").applyInArrow(_added, kinds))
        found = parts.orderBy("shard").collect()  # TOGETHER rows at most
        rest = sum(r["n"] for r in found)
        unflat(model, steps, sum(np.frombuffer(r["sums"], np.float64) for r in found) / rest)
        losses += (np.sum([r["loss"] for r in found], axis=0) / rest).tolist()
        step.clear()
        shared.destroy()
    table.clear()
    return losses


def width(features: DataFrame, column: str) -> int:
    """How many numbers a list column has in each row."""
    row = features.select(F.size(column).alias("n")).first()
    if row is None:
        raise ValueError("at least two contigs are needed")
    return row["n"]
