"""Cumulative sums in a total order without sending a whole key to one task.

Rows are range-partitioned by (keys, order) and stored with the number of their range.
Each range is summed on its own; the few range totals are accumulated in order and
added back. Ranges may split one key, so a key holding most rows stays parallel. Rows are
counted first: a larger table has more ranges and more tasks, not fuller ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.session import stored

RANGE_ROWS = 125_000  # rows of a range, about; a task may be dealt several


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]
) -> DataFrame:
    """Add ``sums`` accumulated up to and including each row. ``order`` must be unique per key."""
    parts = max(1, math.ceil(df.count() / RANGE_ROWS))
    ranged = stored(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    here = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = ranged.groupBy(*here).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = totals.select(
        *here, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]
    )
    inside = Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Offsets join behind the window, so that they are not sorted and held with every row.
    return (
        ranged.repartition(parts, *here)
        .withColumns({f"_upto_{n}": F.sum(c).over(inside) for n, c in sums.items()})
        .join(offsets, here)
        .withColumns({n: F.col(f"_upto_{n}") + F.col(f"_off_{n}") for n in sums})
        .drop("_range", *[f"{p}_{n}" for p in ("_upto", "_off") for n in sums])
    )


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Number all rows 1..n in a total order."""
    return running_totals(df, [], order, {name: F.lit(1).cast("bigint")})
