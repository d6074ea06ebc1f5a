"""Average precision and recall over IoU thresholds, following the COCO protocol.

At most 100 detections per image and class; on equal IoU the later truth wins; a
detection matches at ``min(t, 1 - 1e-10)``; precision is read at 101 recall points
after making it non-increasing. Classes without truth have NULL metrics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.operators.matching import PAIR_LIMIT, by_image, overlaps_of, settle_rounds
from detlake.operators.running import running_totals
from detlake.operators.spatial import grid_pairs, split_sides
from detlake.session import stored

# Fixed values of the protocol.
IOU_THRESHOLDS = [float(t) for t in np.linspace(0.5, 0.95, 10)]
MAX_DETECTIONS = 100
RECALL_POINTS = 101
SPACING = 2.0**-52


def top_detections(
    predictions: DataFrame, keys: list[str], limit: int = MAX_DETECTIONS
) -> DataFrame:
    """The best-scored detections per group; earlier ones win ties.

    The rank filter is applied before the shuffle too, so a crowded group sends at
    most ``limit`` rows per input task.
    """
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), "prediction_index")
    return (
        predictions.withColumn("_rank", F.row_number().over(best_first))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


FLOORS = [min(t, 1 - 1e-10) for t in IOU_THRESHOLDS]


def _reached(iou: Column) -> Column:
    """Bit mask of the thresholds an IoU reaches."""
    return sum((F.when(iou >= f, 1 << k).otherwise(0) for k, f in enumerate(FLOORS)), F.lit(0))


def _serve(floor: float):
    def step(state: Column, row: Column) -> Column:
        free = F.filter(
            row["wishes"],
            lambda o: (o["iou"] >= floor) & ~F.array_contains(state["used"], o["late"]),
        )
        pick = F.array_max(free)["late"]
        return F.struct(
            F.when(pick.isNull(), state["used"])
            .otherwise(F.array_append(state["used"], pick))
            .alias("used"),
            F.array_append(state["hits"], pick.isNotNull()).alias("hits"),
        )

    return step


def _hits_by_image(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """Per detection a bit mask of the IoU thresholds at which it is a true positive.

    Where no two detections of an image want the same truth and none has a choice, the
    mask follows from the IoU alone; the others are served once per threshold.
    """
    met = F.transform(
        "ps",
        lambda p: F.struct(
            p.alias("p"),
            F.filter(
                overlaps_of(p, F.col("ts")), lambda o: o["same"] & (o["iou"] >= FLOORS[0])
            ).alias("near"),
        ),
    )
    rows = F.transform(
        "met",
        lambda r: F.struct(
            r["p"]["prediction_index"].alias("prediction_index"),
            r["p"]["category_id"].alias("category_id"),
            (-r["p"]["rank"]).alias("score"),
            F.transform(
                r["near"], lambda o: F.struct(o["iou"], (-o["first"]).alias("late"))
            ).alias("wishes"),
        ),
    )
    wanted = F.flatten(F.transform("rows", lambda r: r["wishes"]["late"]))
    simple = (F.size(F.array_distinct(wanted)) == F.size(wanted)) & ~F.exists(
        "rows", lambda r: F.size(r["wishes"]) > 1
    )
    start = F.expr(
        "named_struct('used', CAST(array() AS ARRAY<BIGINT>),"
        " 'hits', CAST(array() AS ARRAY<BOOLEAN>))"
    )
    served = [F.aggregate("rows", start, _serve(f))["hits"] for f in FLOORS]
    zipped = F.transform(
        F.arrays_zip(*[h.alias(f"h{k}") for k, h in enumerate(served)]),
        lambda z: sum(
            (F.when(z[f"h{k}"], 1 << k).otherwise(0) for k in range(len(FLOORS))), F.lit(0)
        ),
    )
    direct = F.transform("rows", lambda r: _reached(F.get(r["wishes"], F.lit(0))["iou"]))
    return (
        by_image(truth, detections)
        .select("image_id", met.alias("met"))
        .select("image_id", rows.alias("rows"))
        .withColumn("hits", F.when(simple, direct).otherwise(zipped))
        .select("image_id", F.inline(F.arrays_zip("rows", "hits")))
        .select(
            "image_id", "rows.category_id", "rows.prediction_index", "rows.score",
            F.coalesce("hits", F.lit(0)).alias("hits"),
        )
    )


def _hits_by_rounds(detections: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    floors = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(min(t, 1 - 1e-10)).alias("floor"))
        for k, t in enumerate(IOU_THRESHOLDS)
    ])
    reached = F.filter(floors, lambda f: F.col("iou") >= f["floor"])
    candidates = pairs.select(
        *group,
        F.explode(F.transform(reached, lambda f: f["k"])).alias("k"),
        F.col("p_prediction_index").alias("prediction_index"),
        F.col("p_score").alias("score"),
        F.col("t_annotation_index").alias("annotation_index"),
        "iou",
    )
    kept = settle_rounds(candidates, [*group, "k"], ties="last")
    masks = kept.groupBy(*group, "prediction_index").agg(
        F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("hits")
    )
    return detections.join(masks, [*group, "prediction_index"], "left").select(
        "image_id", "category_id", "prediction_index", "score",
        F.coalesce("hits", F.lit(0)).alias("hits"),
    )


def detection_hits(
    truth: DataFrame, predictions: DataFrame, pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """One row per detection that counts, with its true-positive mask."""
    group = ["image_id", "category_id"]
    calm, calm_truth, busy = split_sides(predictions, truth, ["image_id"], pair_limit)
    # Both are placed by image; ranking per class and gathering per image stay in place.
    hits = _hits_by_image(top_detections(calm, group), calm_truth)
    if busy is None:
        return hits
    detections = stored(top_detections(busy, group), "detections")
    pairs = grid_pairs(
        detections.select(*group, "prediction_index", "score", *"xywh"),
        truth.select(*group, "annotation_index", *"xywh"),
        group,
    ).withColumn("iou", G.iou(*[p + c for p in ("p_", "t_") for c in "xywh"]))
    pairs = pairs.filter(F.col("iou") >= FLOORS[0])
    return hits.unionByName(_hits_by_rounds(detections, pairs, group))


def precision_curve(hits: DataFrame, positives: DataFrame, by: list[str]) -> DataFrame:
    """Precision at 101 recall points per ``by`` + (category_id, iou index k).

    ``positives``: by, category_id, npos. The envelope only ever changes at a true
    positive, so each true positive is dropped into the highest recall point it reaches
    and the rest is a maximum over at most 101 rows per curve.
    """
    keys = [*by, "category_id"]
    names = [f"tp{k}" for k in range(len(IOU_THRESHOLDS))]
    bits = {
        n: F.shiftright("hits", k).bitwiseAND(F.lit(1)).cast("bigint")
        for k, n in enumerate(names)
    }
    ranked = running_totals(
        hits.join(positives.select(*keys, "npos"), keys),
        keys,
        [F.desc("score"), F.asc("image_id"), F.asc("prediction_index")],
        {"rank": F.lit(1).cast("bigint"), **bits},
    )
    cells = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(n).alias("tp")) for k, n in enumerate(names)
    ])
    curve = ranked.select(*keys, "npos", "rank", "hits", F.explode(cells).alias("c")).filter(
        F.expr("shiftright(hits, c.k) & 1 = 1")
    )
    recall = F.col("c.tp") / F.col("npos")
    guess = F.floor(recall * 100)
    point = (
        F.when((guess + 1) * 0.01 <= recall, guess + 1)
        .when(guess * 0.01 > recall, guess - 1)
        .otherwise(guess)
    )
    reached = curve.groupBy(*keys, F.col("c.k").alias("k"), point.cast("int").alias("point")).agg(
        F.max(F.col("c.tp") / (F.col("rank") + F.lit(SPACING))).alias("best")
    )
    grid = positives.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.lit(len(IOU_THRESHOLDS) - 1))).alias("k"),
    ).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(RECALL_POINTS - 1))))
    onward = Window.partitionBy(*keys, "k").orderBy(F.desc("point")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return grid.join(reached, [*keys, "k", "point"], "left").select(
        *keys, "k", "point", F.coalesce(F.max("best").over(onward), F.lit(0.0)).alias("precision")
    )


def average_precision(
    truth: DataFrame,
    predictions: DataFrame,
    by: list[str] | None = None,
    images: DataFrame | None = None,
    pair_limit: int = PAIR_LIMIT,
    classes: list[int] | None = None,
) -> DataFrame:
    """AP50:95, AP50 and AR100 per class, and overall with category_id NULL.

    ``by`` lists columns of ``images`` (such as a source group) to report separately.
    ``classes`` adds classes without truth: no boxes, NULL metrics, no part in the means.
    """
    by = by or []
    hits = detection_hits(truth, predictions, pair_limit)
    if by:
        groups = images.select("image_id", *by)
        hits, truth = hits.join(groups, "image_id"), truth.join(groups, "image_id")
    hits = stored(hits, "hits")
    keys = [*by, "category_id"]
    # One row per class, read three times below.
    positives = stored(
        truth.groupBy(*keys).agg(
            F.count("*").alias("npos"), F.count_distinct("image_id").alias("positive_images")
        ),
        "positives",
    )
    curve = precision_curve(hits, positives, by)
    precision = curve.groupBy(*keys).agg(
        F.avg("precision").alias("ap50_95"),
        F.avg(F.when(F.col("k") == 0, F.col("precision"))).alias("ap50"),
    )
    found = hits.groupBy(*keys).agg(F.sum(F.bit_count("hits")).alias("found"))
    per_class = (
        positives.join(precision, keys)
        .join(found, keys, "left")
        .select(
            *keys,
            "ap50_95",
            "ap50",
            (
                F.coalesce("found", F.lit(0)) / (F.col("npos") * len(IOU_THRESHOLDS))
            ).alias("ar100"),
            F.col("npos").alias("instances"),
            "positive_images",
        )
    )
    if classes is not None:
        ids = F.explode(F.array(*[F.lit(c).cast("bigint") for c in classes]))
        groups = positives.select(*by).distinct() if by else truth.sparkSession.range(1)
        frame = groups.select(*by, ids.alias("category_id"))
        per_class = frame.join(per_class, keys, "left").na.fill(0, ["instances", "positive_images"])
    return per_class.groupingSets([keys, by], *keys).agg(
        F.avg("ap50_95").alias("ap50_95"),
        F.avg("ap50").alias("ap50"),
        F.avg("ar100").alias("ar100"),
        F.sum("instances").alias("instances"),
        F.when(F.grouping("category_id") == 0, F.max("positive_images")).alias("positive_images"),
    )
