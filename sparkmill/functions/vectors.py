"""Functions on array columns that stay in the JVM, and the few that need bits of floats."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def half_unit(v: Column) -> Column:
    """Scaled to length 1 / sqrt(2), so that 0.5 - dot is half the cosine distance; an all-zero row points along the diagonal."""
    v = F.when(F.forall(v, lambda x: x == 0), F.transform(v, lambda x: F.lit(1.0) / F.size(v))).otherwise(v)
    length = F.array(norm(v) * F.sqrt(F.lit(2.0)))  # bound to a name, so that it is worked out once
    return F.get(F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def half_distance(a: Column, b: Column) -> Column:
    """Half the cosine distance of rows from half_unit."""
    return F.lit(0.5) - dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """Whole cosine distance of any two rows."""
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def one_hot(index: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == index).cast("int"))


def first_max(v: Column) -> Column:
    """1-based place of the largest component, the first of equal ones."""
    return F.array_position(v, F.array_max(v)).cast("int")


def zscored(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "z") -> DataFrame:
    """df with (value - mean) / population deviation over each group of `by`; a deviation of zero counts as one.

    The two sums are aggregated before a join, as a window would gather a group in one task.
    """
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    if by:
        return df.join(stats, [*by]).select(*df.columns, z.alias(out))
    mean, deviation = stats.first() or (None, None)
    return df.select("*", ((F.col(value) - F.lit(mean)) / F.lit(deviation or 1.0)).alias(out))


def mask_lower_bits(v: Column, bits: int) -> Column:
    """Each component of an array as float32 with its lowest `bits` mantissa bits zero, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda y: None if y is None else masked(np.asarray(y, np.float32), bits))

    return run(v)


def masked(x: np.ndarray, bits: int) -> np.ndarray:
    """float32 with the lowest `bits` (0 to 23) of the mantissa zero."""
    if not 0 <= bits <= 23:
        raise ValueError("bits must be between 0 and 23")
    return (np.ascontiguousarray(x, np.float32).view(np.uint32) & np.uint32((0xFFFFFFFF << bits) & 0xFFFFFFFF)).view(np.float32)


def running_extreme(df: DataFrame, value: str, order: Sequence[Column], by: Sequence[str], out: str = "before") -> DataFrame:
    """df with the largest value of all rows that come earlier in the order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.max(value).over(w))
