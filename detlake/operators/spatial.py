"""Box-against-box joins that never compare a crowded image pairwise.

Images whose number of possible pairs has been checked to be small are joined on their
keys alone: one shuffle per side, and later groupings by image need none. Crowded ones
go through a grid: every box is listed under the cells it touches and the join runs on
(keys, cell), which spreads one image over many small join groups. Cells are counted
first; one with more possible pairs than ``CELL_PAIRS`` is split in four, again and again
while that parts its boxes, and what still is too full is joined in blocks. The cells that
are joined cover an image without overlap, and a pair is emitted only from the cell that
holds the top-left corner of its intersection, so no de-duplication shuffle follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.session import stored

CELL = 128.0
PAIR_LIMIT = 1_000_000  # possible pairs of one key that may be compared in one task
CELL_PAIRS = 1_000_000  # possible pairs of one cell, or of one block of a cell
SPLITS = 10  # halvings of a cell at most
PARTED = 0.75  # a quarter that keeps more of its cell's rows than this is not split again
SIDE_LIMIT = 5_000  # rows of one key and side that may be gathered in one row
TASK_ROWS = 500_000  # rows of both sides, about, that one task joins or gathers by key


def _span(start: str, size: str, cell: float) -> tuple[Column, Column]:
    first = F.floor(F.col(start) / F.lit(cell))
    return first, F.floor((F.col(start) + F.col(size)) / F.lit(cell))


def _in_cells(df: DataFrame, x: str, y: str, w: str, h: str, cell: float) -> DataFrame:
    return df.withColumn("_gx", F.explode(F.sequence(*_span(x, w, cell)))).withColumn(
        "_gy", F.explode(F.sequence(*_span(y, h, cell)))
    )


def _in_quarters(df: DataFrame, x: str, y: str, w: str, h: str, half: float) -> DataFrame:
    """Rows listed under (_gx, _gy) again, under those quarters of the cell that they touch."""

    def kept(cell: str, start: str, size: str) -> Column:
        ends = _span(start, size, half)
        two = F.array(F.col(cell) * 2, F.col(cell) * 2 + 1)
        return F.explode(F.filter(two, lambda c: c.between(F.least(*ends), F.greatest(*ends))))

    return df.withColumn("_gx", kept("_gx", x, w)).withColumn("_gy", kept("_gy", y, h))


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def _key_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if left is right:
        return left.groupBy(*keys).agg(F.count("*").alias("_l")).withColumn("_r", F.col("_l"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = left.select(*keys, one.alias("_l"), none.alias("_r")).unionByName(
        right.select(*keys, none.alias("_l"), one.alias("_r"))
    )
    return rows.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def _is_crowded(limit: int, side: int | None) -> Column:
    crowded = F.col("_l") * F.col("_r") > limit
    return crowded if side is None else crowded | (F.greatest("_l", "_r") > side)


def crowded_keys(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    limit: int = PAIR_LIMIT,
    side: int | None = None,
) -> DataFrame:
    """Keys with more than ``limit`` possible pairs, or more than ``side`` rows on a side."""
    return _key_sizes(left, right, keys).filter(_is_crowded(limit, side)).select(*keys)


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows: one for each core at least, of about ``TASK_ROWS`` rows."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def _counted(
    left: DataFrame, right: DataFrame, keys: list[str], limit: int, side: int | None = None
) -> tuple[DataFrame | None, int]:
    """(crowded keys or None when there are none, partitions for the others)."""
    sizes = _key_sizes(left, right, keys).agg(
        F.sum(F.col("_l") + F.col("_r")).alias("rows"), F.count_if(_is_crowded(limit, side)).alias("crowded")
    ).first()
    parts = task_count(left.sparkSession, sizes["rows"] or 0)
    if not sizes["crowded"]:
        return None, parts
    return stored(crowded_keys(left, right, keys, limit, side), "crowded"), parts


def split_crowded(
    left: DataFrame, right: DataFrame, keys: list[str], limit: int = PAIR_LIMIT
) -> tuple[DataFrame, DataFrame | None]:
    """(left rows of calm keys, left rows of crowded keys or None when there are none).

    Calm rows are dealt by key to tasks of about ``TASK_ROWS`` rows of both sides, so that a
    larger table makes more tasks and not fuller ones.
    """
    crowded, parts = _counted(left, right, keys, limit)
    if crowded is None:
        return left.repartition(parts, *keys), None
    calm = left.join(crowded, keys, "left_anti").repartition(parts, *keys)
    return calm, left.join(crowded, keys, "left_semi")


def split_sides(
    left: DataFrame, right: DataFrame, keys: list[str], limit: int, side: int = SIDE_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(left and right rows of calm keys, left rows of crowded keys or None).

    What is calm may be gathered by key: no key has more than ``side`` rows on either side,
    also if the other side has none. Both sides are dealt by key as in ``split_crowded``.
    """
    crowded, parts = _counted(left, right, keys, limit, side)
    if crowded is None:
        return left.repartition(parts, *keys), right.repartition(parts, *keys), None
    calm = (df.join(crowded, keys, "left_anti").repartition(parts, *keys) for df in (left, right))
    return *calm, left.join(crowded, keys, "left_semi")


def touching(a: str, b: str) -> Column:
    """Two xywh boxes with column prefixes ``a`` and ``b`` share area."""
    ax, ay, aw, ah = (F.col(a + c) for c in "xywh")
    bx, by, bw, bh = (F.col(b + c) for c in "xywh")
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def _full_cells(a: DataFrame, b: DataFrame, cells: list[str], limit: int) -> DataFrame:
    """Cells with more than ``limit`` possible pairs: (cells, _l, _r, _parted)."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = a.select(*cells, "_from", one.alias("_l"), none.alias("_r")).unionByName(
        b.select(*cells, "_from", none.alias("_l"), one.alias("_r"))
    )
    sizes = rows.groupBy(*cells).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), F.max("_from").alias("_from"))
    parted = F.col("_l") + F.col("_r") <= F.col("_from") * PARTED
    return sizes.filter(F.col("_l") * F.col("_r") > limit).select(
        *cells, "_l", "_r", (F.col("_from").isNull() | parted).alias("_parted")
    )


def _in_blocks(df: DataFrame, own: str, other: str, sizes: tuple[str, str], side: int) -> DataFrame:
    """Rows of full cells under one block of their own side and every block of the other.

    Rows are dealt by their content, so only rows that are equal in every column stay together.
    """
    mine, others = (F.ceil(F.col(n) / F.lit(side)).cast("bigint") for n in sizes)
    columns = [c for c in df.columns if c not in ("_l", "_r", "_parted", "_from")]
    return df.withColumn(own, F.pmod(F.xxhash64(*columns), mine)).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1))
    )


def grid_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], left_prefix: str = "p_",
    right_prefix: str = "t_", cell: float = CELL, limit: int | None = None,
) -> DataFrame:
    """Pairs that share area, by way of grid cells of at most ``limit`` possible pairs."""
    limit = CELL_PAIRS if limit is None else limit
    cells = [*keys, "_gx", "_gy"]
    boxes = [[prefix + c for c in "xywh"] for prefix in (left_prefix, right_prefix)]
    a, b = (
        _in_cells(_prefixed(df, keys, prefix), *box, cell=cell).withColumn("_from", F.lit(None).cast("bigint"))
        for df, prefix, box in zip((left, right), (left_prefix, right_prefix), boxes)
    )
    lx, ly, rx, ry = (F.col(p + c) for p in (left_prefix, right_prefix) for c in "xy")
    extra = ("_gx", "_gy", "_from", "_l", "_r", "_parted", "_u", "_v")

    def met(a: DataFrame, b: DataFrame, on: list[str], cell: float) -> DataFrame:
        corner_here = (F.floor(F.greatest(lx, rx) / F.lit(cell)) == F.col("_gx")) & (
            F.floor(F.greatest(ly, ry) / F.lit(cell)) == F.col("_gy")
        )
        once = b.drop(*[c for c in extra if c not in on])
        return a.join(once, on).filter(corner_here & touching(left_prefix, right_prefix)).drop(*extra)

    full = _full_cells(a, b, cells, limit)
    if full.isEmpty():
        return met(a, b, cells, cell)
    pairs = None
    for halvings in range(SPLITS + 1):
        full = stored(full, "full-cells")
        calm = met(a.join(full, cells, "left_anti"), b, cells, cell)
        pairs = calm if pairs is None else pairs.unionByName(calm)
        if full.isEmpty():
            break
        split = F.col("_parted") if halvings < SPLITS else F.lit(False)
        a, b = a.join(full, cells), b.join(full, cells)
        side = max(1, int(limit**0.5))
        blocked = met(
            _in_blocks(a.filter(~split), "_u", "_v", ("_l", "_r"), side),
            _in_blocks(b.filter(~split), "_v", "_u", ("_r", "_l"), side),
            [*cells, "_u", "_v"], cell,
        )
        pairs = pairs.unionByName(blocked)
        if halvings == SPLITS:
            break
        cell /= 2
        a, b = (
            stored(
                _in_quarters(
                    df.filter(split).withColumn("_from", F.col("_l") + F.col("_r")).drop("_l", "_r", "_parted"),
                    *box, half=cell,
                ),
                "quarters",
            )
            for df, box in zip((a, b), boxes)
        )
        full = _full_cells(a, b, cells, limit)
    return pairs


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_prefix: str = "p_",
    right_prefix: str = "t_",
    cell: float = CELL,
    limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Pairs of xywh boxes that agree on ``keys`` and share area, with their ``iou``."""
    calm, busy = split_crowded(left, right, keys, limit)
    pairs = (
        _prefixed(calm, keys, left_prefix)
        .join(_prefixed(right, keys, right_prefix), keys)
        .filter(touching(left_prefix, right_prefix))
    )
    if busy is not None:
        pairs = pairs.unionByName(grid_pairs(busy, right, keys, left_prefix, right_prefix, cell))
    return pairs.withColumn(
        "iou", G.iou(*[p + c for p in (left_prefix, right_prefix) for c in "xywh"])
    )
