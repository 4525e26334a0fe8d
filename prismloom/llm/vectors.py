"""Vectors as integers, and totals by a column whose values may be very uneven."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a unit, and the greatest magnitude of a component in steps: so sums of squared differences fit 64 bits.
STEPS, MOST_STEPS = 256, 1 << 25
#: A value is heavy if over one row in so many has it, so no more than this many are.
HEAVY = 1000


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and has all of them finite."""
    x = vector.cast("array<double>")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))


def common_size(rows: DataFrame, vector: str) -> int:
    """The number of components of all vectors, 0 if there are none; ValueError if they differ."""
    size = F.size(vector)
    least, most = rows.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"vectors have {least} to {most} components; they must have the same number")
    return least or 0


def steps(vectors: pa.Array) -> np.ndarray:
    """(row, component): floor(256 * component) of lists of doubles of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    found = np.floor(flat * STEPS)
    if len(found) and np.abs(found).max() > MOST_STEPS:
        raise ValueError(f"components must lie within {MOST_STEPS / STEPS:.0f}")
    return found.astype(np.int64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), dtype=np.int64)


def with_total(rows: DataFrame, key: str, value: str, total: str, *, spread: tuple[str, ...]) -> DataFrame:
    """The rows with the sum of ``value`` over all rows of an equal key, nulls together; the key's column goes.

    Sums are combined before they are exchanged. Sums of heavy values, at most HEAVY, are broadcast; the others are joined by
    the key, while rows of heavy values are dealt by ``spread``, so none gathers in one task.
    """
    sums = rows.groupBy(key).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    n = rows.count()
    heavy = sums.where(F.col("_n") * HEAVY > n).select(F.col(key).alias("_heavy"), F.col("_sum").alias("_at_once"), F.lit(True).alias("_is_heavy"))
    light = sums.where(F.col("_n") * HEAVY <= n).select(F.col(key).alias("_light"), F.lit(0).alias("_slot"), F.col("_sum").alias("_joined"))
    marked = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy")), "left")
    slot = F.when(F.col("_is_heavy"), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(0).cast("int")
    found = marked.withColumn("_own", slot).join(light, F.col(key).eqNullSafe(F.col("_light")) & (F.col("_own") == F.col("_slot")), "left")
    return found.withColumn(total, F.coalesce("_at_once", "_joined")).drop(key, "_heavy", "_at_once", "_is_heavy", "_own", "_light", "_slot", "_joined")
