"""Joins of boxes in crowded images: cells follow the density of the boxes."""

import random

import pytest
from pyspark.sql import functions as F

from detlake import session
from detlake.operators import matching as M
from detlake.operators import spatial as S
from detlake.operators import tiles as L

SCHEMA = "image_id long, i long, x double, y double, w double, h double"


def boxes(seed, many, spread, size, image=1):
    random_ = random.Random(seed)
    return [
        (image, i, random_.uniform(0, spread), random_.uniform(0, spread), random_.uniform(0.5, size), random_.uniform(0.5, size))
        for i in range(many)
    ]


def plain(left, right):
    return sorted(
        (a[0], a[1], b[1])
        for a in left
        for b in right
        if a[0] == b[0]
        and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]
        and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    )


@pytest.mark.parametrize("halvings", [0, 2, 10])
def test_cells_of_any_depth_equal_plain_pairs(spark, monkeypatch, halvings):
    monkeypatch.setattr(S, "SPLITS", halvings)
    left = boxes(1, 150, 60, 6) + boxes(2, 40, 400, 90, 2) + boxes(3, 30, 3, 50)
    right = boxes(4, 150, 60, 6) + boxes(5, 40, 400, 90, 2) + [(1, 900, 0.0, 0.0, 128.0, 128.0)] * 2
    right.append((1, 901, None, 2.0, 3.0, 4.0))
    left.append((1, 902, 64.0, 64.0, 32.0, 32.0))
    got = S.grid_pairs(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["image_id"], limit=400
    )
    rows = sorted((r.image_id, r.p_i, r.t_i) for r in got.collect())
    assert rows == plain(left, [b for b in right if b[2] is not None])


def test_full_cells_are_parted(spark, monkeypatch):
    """Many small boxes in one spot, or as many large ones over each other: no join group is above the limit."""
    seen = []
    whole = S.touching

    def counted(a, b):
        seen.append((a, b))
        return whole(a, b)

    monkeypatch.setattr(S, "touching", counted)
    small = spark.range(4000).select(
        F.lit(1).cast("long").alias("image_id"), F.col("id").alias("i"),
        (F.col("id") % 80 * 0.75).alias("x"), (F.floor(F.col("id") / 80) * 0.75).cast("double").alias("y"),
        F.lit(0.5).alias("w"), F.lit(0.5).alias("h"),
    )
    got = S.grid_pairs(small, small, ["image_id"], limit=10_000)
    assert got.count() == 4000 and len(seen) > 3
    a = S._in_cells(small, "x", "y", "w", "h", 128.0).withColumn("_from", F.lit(None).cast("bigint"))
    assert not S._full_cells(a, a, ["image_id", "_gx", "_gy"], 10_000).isEmpty()
    large = spark.range(700).select(
        F.lit(1).cast("long").alias("image_id"), F.col("id").alias("i"), (F.col("id") * 0.01).alias("x"),
        F.lit(0.0).alias("y"), F.lit(100.0).alias("w"), F.lit(100.0).alias("h"),
    )
    assert S.grid_pairs(large, large, ["image_id"], limit=10_000).count() == 700 * 700


def test_larger_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 10)
    boxes = spark.range(200).select((F.col("id") % 50).alias("image_id"), *[F.lit(1.0).alias(c) for c in "xywh"])
    calm, busy = S.split_crowded(boxes, boxes, ["image_id"])
    assert (calm.rdd.getNumPartitions(), busy) == (40, None)
    left, right, busy = S.split_sides(boxes, boxes, ["image_id"], 1_000)
    assert (left.rdd.getNumPartitions(), right.rdd.getNumPartitions(), busy) == (40, 40, None)
    assert left.count() == right.count() == 200


def test_only_contested_candidates_go_through_rounds(spark, monkeypatch):
    sizes = []

    def recorded(df, label="step"):
        out = session.stored(df, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(M, "stored", recorded)
    alone = spark.range(300).select(
        (F.col("id") % 7).alias("image_id"), F.col("id").alias("prediction_index"), F.col("id").alias("annotation_index"),
        F.lit(0.5).alias("score"), F.lit(0.9).alias("iou"),
    )
    # Two predictions want truth 1000; the better one takes it, the other takes 1001.
    shared = spark.createDataFrame(
        [(0, 1000, 1000, 0.9, 0.7), (0, 1001, 1000, 0.8, 0.8), (0, 1001, 1001, 0.8, 0.6)], alone.schema
    )
    kept = M.settle_rounds(alone.unionByName(shared), ["image_id"])
    assert kept.count() == 302
    assert {tuple(r)[1:] for r in kept.filter("prediction_index >= 1000").collect()} == {(1000, 1000), (1001, 1001)}
    assert sizes[0] == ("candidates", 303)
    assert all(n <= 3 for _, n in sizes[1:])


def test_tile_detections_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 5)
    detections = spark.range(200).select(
        (F.col("id") % 50).alias("image_id"), F.lit(0).alias("tile"), F.col("id").alias("prediction_index"),
        *[F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    )
    tiles = spark.range(50).select(
        F.col("id").alias("image_id"), F.lit(0).alias("tile"), F.lit(3).alias("tx1"), F.lit(4).alias("ty1"),
        F.lit(64).alias("width"), F.lit(64).alias("height"),
    )
    restored = L.restore_boxes(detections, tiles)
    assert restored.rdd.getNumPartitions() == 40
    assert {(r["x1"], r["y2"]) for r in restored.collect()} == {(3.0, 7.0)} and restored.count() == 200
