"""Tiled views of large images, their labels, and merging of tiled detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.operators.matching import PAIR_LIMIT
from detlake.operators.precision import MAX_DETECTIONS, top_detections
from detlake.operators.spatial import grid_pairs, split_crowded, task_count, touching
from detlake.session import stored

NMS_IOU = 0.5


def tile_starts(length: int, size: int, overlap: int) -> list[int]:
    """Offsets of tiles along one side; the last tile ends at the edge."""
    _check(size, overlap)
    last = max(length - size, 0)
    return sorted({*range(0, last + 1, size - overlap), last})


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("tile size must be positive and overlap smaller than the tile")


def _starts(length: Column, size: int, overlap: int) -> Column:
    last = F.greatest(length - size, F.lit(0))
    steps = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.array_sort(F.array_union(steps, F.array(last)))


def tile_grid(images: DataFrame, size: int, overlap: int) -> DataFrame:
    """One row per tile of every image; size 0 keeps the image whole."""
    if size == 0:
        return images.select(
            "*", F.lit(0).alias("tile"), F.lit(0).alias("tx1"), F.lit(0).alias("ty1"),
            F.col("width").alias("tx2"), F.col("height").alias("ty2"),
        )
    _check(size, overlap)
    rows = images.withColumn("_ys", _starts(F.col("height"), size, overlap)).withColumn(
        "_xs", _starts(F.col("width"), size, overlap)
    )
    tiles = rows.select(
        "*", F.posexplode("_ys").alias("_row", "ty1")
    ).select("*", F.posexplode("_xs").alias("_column", "tx1"))
    return tiles.select(
        *images.columns,
        (F.col("_row") * F.size("_xs") + F.col("_column")).alias("tile"),
        "tx1",
        "ty1",
        F.least(F.col("width"), F.col("tx1") + size).alias("tx2"),
        F.least(F.col("height"), F.col("ty1") + size).alias("ty2"),
    )


def image_views(
    images: DataFrame, split: str, size: int = 0, overlap: int = 0, limit: int | None = None,
    order: str = "image_id",
) -> DataFrame:
    """Tiles of one split, optionally of its first ``limit`` images only."""
    chosen = images.filter(F.col("split") == split)
    if limit is not None:
        if limit < 1:
            raise ValueError("image limit must be positive")
        chosen = chosen.orderBy(order).limit(limit)
    return tile_grid(chosen, size, overlap)


def tile_annotations(tiles: DataFrame, annotations: DataFrame, cell: float = 512.0) -> DataFrame:
    """Labels of every tile in tile coordinates, with the tile's corner; tiles without labels
    appear with NULLs.

    ``tiles``: image_id, tile and tx1..ty2; ``annotations``: image_id, annotation_index,
    class_id, x1..y2. Labels get class_id + 1, since 0 means background.
    """
    frame = tiles.select(
        "image_id", "tile", "tx1", "ty1", "tx2", "ty2",
        F.col("tx1").cast("double").alias("v_x"), F.col("ty1").cast("double").alias("v_y"),
        (F.col("tx2") - F.col("tx1")).cast("double").alias("v_w"),
        (F.col("ty2") - F.col("ty1")).cast("double").alias("v_h"),
    )
    boxes = annotations.select(
        "image_id", "annotation_index", (F.col("class_id") + 1).alias("label"),
        "x1", "y1", "x2", "y2", *G.xyxy_to_xywh("x1", "y1", "x2", "y2"),
    )
    calm, busy = split_crowded(frame, boxes, ["image_id"])
    named = boxes.withColumnsRenamed({"image_id": "_image", **{c: f"b_{c}" for c in "xywh"}})
    here = (F.col("image_id") == F.col("_image")) & touching("v_", "b_")
    clipped = calm.join(named, here, "left").drop("_image")
    if busy is not None:
        windows = busy.select("image_id", "tile", *[F.col(f"v_{c}").alias(c) for c in "xywh"])
        fields = ["annotation_index", "label", "x1", "y1", "x2", "y2"]
        met = grid_pairs(windows, boxes, ["image_id"], "v_", "b_", cell).select(
            "image_id", F.col("v_tile").alias("tile"), *[F.col(f"b_{c}").alias(c) for c in fields]
        )
        shared = busy.join(met, ["image_id", "tile"], "left")
        clipped = clipped.select(*shared.columns).unionByName(shared)
    return clipped.select(
        "image_id",
        "tile",
        "tx1",
        "ty1",
        "annotation_index",
        "label",
        (F.greatest("x1", "tx1") - F.col("tx1")).alias("x1"),
        (F.greatest("y1", "ty1") - F.col("ty1")).alias("y1"),
        (F.least("x2", "tx2") - F.col("tx1")).alias("x2"),
        (F.least("y2", "ty2") - F.col("ty1")).alias("y2"),
    ).withColumns(
        {
            c: F.when(F.col("annotation_index").isNotNull(), F.col(c))
            for c in ("x1", "y1", "x2", "y2")
        }
    )


def restore_boxes(detections: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile-local detections in image coordinates.

    Both sides are dealt by image, so that more detections make more tasks and not fuller ones.
    """
    parts = task_count(detections.sparkSession, detections.count())
    origin = tiles.select("image_id", "tile", "tx1", "ty1", "width", "height").repartition(parts, "image_id")
    return detections.repartition(parts, "image_id").join(origin, ["image_id", "tile"]).withColumns(
        {
            "x1": F.col("x1") + F.col("tx1"),
            "y1": F.col("y1") + F.col("ty1"),
            "x2": F.col("x2") + F.col("tx1"),
            "y2": F.col("y2") + F.col("ty1"),
        }
    ).drop("tx1", "ty1")


def clamp_detections(detections: DataFrame, classes: int) -> DataFrame:
    """Clamp to the image; drop boxes that vanish and classes that do not exist."""
    held = detections.withColumns(
        dict(
            zip(
                ("x1", "y1", "x2", "y2"),
                G.clamp_to_image("x1", "y1", "x2", "y2", "width", "height"),
            )
        )
    )
    return held.filter(
        (F.col("x2") > F.col("x1"))
        & (F.col("y2") > F.col("y1"))
        & F.col("category_id").between(1, classes)
    )


def _suppression_pairs(detections: DataFrame, floor: float) -> DataFrame:
    """(image, class, loser, winner) where the better-scored winner overlaps the loser."""
    keys = ["image_id", "category_id"]
    boxes = detections.select(*keys, "prediction_index", "score", *"xywh")
    better = (F.col("p_score") > F.col("t_score")) | (
        (F.col("p_score") == F.col("t_score"))
        & (F.col("p_prediction_index") < F.col("t_prediction_index"))
    )
    pairs = grid_pairs(boxes, boxes, keys).withColumn(
        "iou", G.iou(*[p + c for p in ("p_", "t_") for c in "xywh"])
    )
    return pairs.filter(better & (F.col("iou") > floor)).select(
        *keys,
        F.col("t_prediction_index").alias("prediction_index"),
        F.col("p_prediction_index").alias("winner"),
    )


def _keep_by_image(detections: DataFrame, floor: float) -> DataFrame:
    """Boxes of each image are visited by falling score against those kept so far."""
    box = F.struct((-F.col("score")).alias("rank"), "prediction_index", "category_id", *"xywh")

    def visit(kept: Column, p: Column) -> Column:
        beaten = F.exists(
            kept,
            lambda k: (k["category_id"] == p["category_id"])
            & (k["x"] < p["x"] + p["w"]) & (p["x"] < k["x"] + k["w"])
            & (k["y"] < p["y"] + p["h"]) & (p["y"] < k["y"] + k["h"])
            & (G.iou(*[b[c] for b in (k, p) for c in "xywh"]) > floor),
        )
        return F.when(beaten, kept).otherwise(F.array_append(kept, p))

    gathered = detections.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("ps"))
    none = F.filter("ps", lambda p: F.lit(False))
    return gathered.select("image_id", F.inline(F.aggregate("ps", none, visit))).select(
        "image_id", "category_id", "prediction_index", (-F.col("rank")).alias("score"), *"xywh"
    )


def _keep_by_rounds(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """A box without living winners is kept; what it suppresses leaves; repeat."""
    keys = ["image_id", "category_id", "prediction_index"]
    pairs = stored(pairs, "suppression")
    alive = stored(detections.select(*keys), "alive")
    kept = None
    number = 0
    while True:
        # Pairs are always among living boxes, so a box that loses none is kept.
        winners = alive.join(pairs.select(*keys), keys, "left_anti")
        winners = stored(winners, "kept")
        kept = winners if kept is None else kept.unionByName(winners)
        number += 1
        named = winners.withColumnRenamed("prediction_index", "winner")
        gone = pairs.join(named, ["image_id", "category_id", "winner"], "left_semi").select(*keys)
        alive = stored(
            alive.join(winners, keys, "left_anti").join(gone, keys, "left_anti"), "alive"
        )
        if alive.isEmpty():
            return kept
        living = alive.withColumnRenamed("prediction_index", "winner")
        pairs = stored(
            pairs.join(alive, keys, "left_semi").join(
                living, ["image_id", "category_id", "winner"], "left_semi"
            ),
            "suppression",
        )


def suppress_overlaps(
    detections: DataFrame, floor: float = NMS_IOU, pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """Per image and class keep a box unless a kept, better-scored one overlaps it.

    ``detections``: image_id, category_id, prediction_index, score, x, y, w, h.
    """
    columns = ["image_id", "category_id", "prediction_index", "score", *"xywh"]
    boxes = detections.select(*columns)
    calm, busy = split_crowded(boxes, boxes, ["image_id"], pair_limit)
    kept = _keep_by_image(calm, floor)
    if busy is None:
        return kept
    busy = stored(busy, "detections")
    chosen = _keep_by_rounds(busy, _suppression_pairs(busy, floor))
    return kept.unionByName(
        busy.join(chosen, ["image_id", "category_id", "prediction_index"], "left_semi")
    )


def merge_tiles(detections: DataFrame, tiles: DataFrame, classes: int) -> DataFrame:
    """Tile-local detections to final ones: restore, clamp, suppress, best 100 per image."""
    restored = clamp_detections(restore_boxes(detections, tiles), classes)
    boxes = restored.select(
        "image_id", "category_id", "prediction_index", "score",
        *G.xyxy_to_xywh("x1", "y1", "x2", "y2"),
    )
    return top_detections(suppress_overlaps(boxes), ["image_id"], MAX_DETECTIONS)
