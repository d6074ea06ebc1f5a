"""Vectors on an integer grid, packed for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector is there and none of its entries is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))
    )


def on_grid(vector: Column, scale: int, shift: int = 0) -> Column:
    """Each entry c, as a double, as the long floor(scale * c) + shift."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of longs; short rows are filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def summed(df: DataFrame, numbers, size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` doubles that ``numbers`` makes of each Arrow batch of ``df``.

    Every task adds up its own; Spark adds up the tasks' numbers, so the driver gets
    ``size`` numbers however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += numbers(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "value"])

    out = np.zeros(size)
    for row in df.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[row["i"]] = row["value"]
    return out
