"""SQL names for the geometry predicates, and a table function for tiles."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _starts(length: str) -> str:
    """SQL for the first pixels of the tiles along a side; the last tile ends at its edge."""
    last = f"greatest({length} - size, 0)"
    return f"array_union(sequence(0, {last}, greatest(size - overlap, 1)), array({last}))"


#: Tiles of one image by built-in functions alone; size 0 keeps the image whole.
_TILES = f"""
CREATE OR REPLACE TEMPORARY FUNCTION tiles(width INT, height INT, size INT, overlap INT)
RETURNS TABLE(x1 INT, y1 INT, x2 INT, y2 INT)
RETURN SELECT x, y, if(size = 0, width, least(width, x + size)), if(size = 0, height, least(height, y + size))
FROM (SELECT if(size = 0, array(0), {_starts("height")}) AS ys, if(size = 0, array(0), {_starts("width")}) AS xs)
LATERAL VIEW explode(ys) AS y LATERAL VIEW explode(xs) AS x
"""


def register_sql(spark: SparkSession) -> None:
    """Create iou, box_valid and hamming as SQL functions and tiles as a table function.

    The scalar functions are SQL bodies: they are inlined into the calling plan.
    """
    box = "{p}x DOUBLE, {p}y DOUBLE, {p}w DOUBLE, {p}h DOUBLE"
    shared = (
        "greatest(0D, least(ax + aw, bx + bw) - greatest(ax, bx))"
        " * greatest(0D, least(ay + ah, by + bh) - greatest(ay, by))"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION iou({box.format(p='a')}, {box.format(p='b')})"
        f" RETURNS DOUBLE RETURN CASE WHEN aw * ah + bw * bh - {shared} > 0"
        f" THEN {shared} / (aw * ah + bw * bh - {shared}) ELSE 0D END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION box_valid(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE,"
        " width DOUBLE, height DOUBLE) RETURNS BOOLEAN RETURN coalesce(x >= 0 AND y >= 0"
        " AND w > 0 AND h > 0 AND x + w <= width + 1e-6D AND y + h <= height + 1e-6D, FALSE)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION hamming(a BIGINT, b BIGINT) RETURNS INT"
        " RETURN bit_count(a ^ b)"
    )
    spark.sql(_TILES)
