"""Error counts, false-positive contexts, miss reasons and size bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.operators.matching import IOU_FLOOR
from detlake.operators.spatial import overlapping_pairs, task_count
from detlake.session import stored

# Reporting thresholds.
THRESHOLDS = (0.05, 0.25, 0.5)


def _at(thresholds) -> Column:
    return F.array(*[F.lit(float(t)) for t in thresholds])


def per_threshold(matches: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The matches retained at each threshold, one copy per threshold they reach."""
    reached = F.filter(_at(thresholds), lambda t: F.col("score") >= t)
    return matches.withColumn("score_threshold", F.explode(reached))


def error_counts(
    truth: DataFrame,
    matches: DataFrame,
    levels: dict[str, list[str]],
    thresholds=THRESHOLDS,
) -> DataFrame:
    """tp, fp, fn, precision and recall at several levels in one aggregation.

    ``levels`` names each grouping, e.g. ``{"micro": [], "class": ["category_id"],
    "board": ["image_id"]}``. Truth at a level without predictions still appears.
    """
    columns = sorted({c for group in levels.values() for c in group})
    taken = F.col("outcome") == "matched"
    reached = [(F.col("score") >= float(t)).cast("int") for t in thresholds]
    tp = [(r * taken.cast("int")).alias(f"tp{i}") for i, r in enumerate(reached)]
    fp = [(r * (~taken).cast("int")).alias(f"fp{i}") for i, r in enumerate(reached)]
    rows = matches.select(*columns, *tp, *fp, F.lit(0).alias("labels"))
    zeros = [F.lit(0).alias(c) for i in range(len(thresholds)) for c in (f"tp{i}", f"fp{i}")]
    labels = truth.select(*columns, *zeros, F.lit(1).alias("labels"))
    # Thresholds stay side by side until rows are summed to the finest level, so that
    # nothing is copied per threshold before it has become small. Rows by image are dealt to
    # tasks by the size of the truth, matches taken to be about as many; few groups are not dealt.
    sums = [c for c in rows.columns if c not in columns]
    both = rows.unionByName(labels)
    if "image_id" in columns:
        both = both.repartition(task_count(truth.sparkSession, 2 * truth.count()), *columns)
    summed = both.groupBy(*columns).agg(*[F.sum(c).alias(c) for c in sums])
    finest = summed.select(
        *columns,
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(float(t)).alias("score_threshold"),
                    F.col(f"tp{i}").alias("tp"),
                    F.col(f"fp{i}").alias("fp"),
                    F.col("labels"),
                )
                for i, t in enumerate(thresholds)
            ])
        ),
    )
    sets = [["score_threshold", *group] for group in levels.values()]
    level = F.lit(None).cast("string")
    for name, group in levels.items():
        present = F.lit(True)
        for c in columns:
            present = present & (F.grouping(c) == (0 if c in group else 1))
        level = F.when(present, F.lit(name)).otherwise(level)
    counted = finest.groupingSets(sets, "score_threshold", *columns).agg(
        level.alias("level"), *[F.sum(c).alias(c) for c in ("tp", "fp", "labels")]
    )
    return G.with_rates(
        counted.withColumn("fn", F.col("labels") - F.col("tp")).drop("labels")
    )


def error_profile(truth: DataFrame, matches: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    levels = {"micro": [], "class": ["category_id"], "board": ["image_id"]}
    return error_counts(truth, matches, levels, thresholds)


def false_positive_contexts(
    matches: DataFrame, thresholds=THRESHOLDS, by: tuple[str, ...] = ()
) -> DataFrame:
    wrong = per_threshold(matches.filter(F.col("outcome") != "matched"), thresholds)
    return wrong.groupBy("score_threshold", *by, "outcome").agg(F.count("*").alias("n"))


def false_positive_items(
    matches: DataFrame, threshold: float, category: int | None = None, context: str | None = None
) -> DataFrame:
    """False positives to look at, optionally of one class or one context."""
    items = matches.filter((F.col("score") >= threshold) & (F.col("outcome") != "matched"))
    if category is not None:
        items = items.filter(F.col("category_id") == category)
    if context is not None:
        items = items.filter(F.col("outcome") == context)
    return items


def board_review_order(images: DataFrame, items: DataFrame) -> DataFrame:
    """Boards by their highest false-positive score; boards without one come last."""
    top = items.groupBy("image_id").agg(F.max("score").alias("top_score"))
    return (
        images.join(top, "image_id", "left")
        .withColumn("top_score", F.coalesce("top_score", F.lit(-1.0)))
        .orderBy(F.desc("top_score"), "image_id")
    )


def boards_by_misses(images: DataFrame, missed: DataFrame) -> DataFrame:
    """Boards with most missed truth first."""
    misses = missed.groupBy("image_id").agg(F.count("*").alias("misses"))
    return (
        images.join(misses, "image_id", "left")
        .withColumn("misses", F.coalesce("misses", F.lit(0)))
        .orderBy(F.desc("misses"), "image_id")
    )


def best_overlaps(left: DataFrame, right: DataFrame, index: str, right_index: str) -> DataFrame:
    """For each left box the right box it overlaps most; the first one wins a tie.

    Left boxes that overlap nothing have index NULL and IoU 0.
    """
    pairs = overlapping_pairs(
        left.select("image_id", index, *"xywh"), right.select("image_id", right_index, *"xywh"),
        ["image_id"],
    )
    best = pairs.groupBy("image_id", F.col(f"p_{index}").alias(index)).agg(
        F.max(F.struct("iou", (-F.col(f"t_{right_index}")).alias("first"))).alias("best")
    )
    return left.join(best, ["image_id", index], "left").select(
        *left.columns,
        (-F.col("best.first")).alias("best_index"),
        F.coalesce("best.iou", F.lit(0.0)).alias("best_iou"),
    )


def explain_misses(missed: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Why each missed truth box was missed, with the predictions that tell.

    Candidates are ranked by (IoU, score, earlier index). A truth box that nothing
    overlaps still names its best-scored candidate, with IoU 0.
    """
    # Usually the outcome of a matching, and needed three times below.
    missed = stored(missed, "missed")
    kept = F.col("score") >= threshold
    order = F.struct(
        F.col("iou").alias("iou"),
        F.col("t_score").alias("score"),
        (-F.col("t_prediction_index")).alias("first"),
        F.col("t_category_id").alias("category_id"),
    )
    same = F.col("p_category_id") == F.col("t_category_id")
    retained = F.col("t_score") >= threshold
    near = (
        overlapping_pairs(
            missed.select("image_id", "annotation_index", "category_id", *"xywh"),
            predictions.select("image_id", "prediction_index", "category_id", "score", *"xywh"),
            ["image_id"],
        )
        .groupBy("image_id", F.col("p_annotation_index").alias("annotation_index"))
        .agg(
            F.max(F.when(retained & same, order)).alias("near_same"),
            F.max(F.when(retained & ~same, order)).alias("near_other"),
            F.max(F.when(~retained & same, order)).alias("near_low"),
        )
    )
    # Best-scored prediction per image and class: the answer where nothing overlaps.
    apart = F.struct(
        F.lit(0.0).alias("iou"),
        F.col("score").alias("score"),
        (-F.col("prediction_index")).alias("first"),
        F.col("category_id").alias("category_id"),
    )
    tops = predictions.groupBy("image_id", "category_id").agg(
        F.max(F.when(kept, apart)).alias("top_kept"), F.max(F.when(~kept, apart)).alias("top_low")
    )
    by_class = tops.groupBy("image_id").agg(F.collect_list("top_kept").alias("tops"))
    found = (
        missed.join(near, ["image_id", "annotation_index"], "left")
        .join(tops, ["image_id", "category_id"], "left")
        .join(by_class, "image_id", "left")
        .withColumns(
            {
                "best_same": F.coalesce("near_same", "top_kept"),
                "best_other": F.coalesce(
                    "near_other",
                    F.array_max(
                        F.filter("tops", lambda t: t["category_id"] != F.col("category_id"))
                    ),
                ),
                "best_low": F.coalesce("near_low", "top_low"),
            }
        )
    )
    overlap = {n: F.coalesce(f"best_{n}.iou", F.lit(0.0)) for n in ("same", "other", "low")}
    reason = (
        F.when(overlap["same"] >= IOU_FLOOR, "matching_competition")
        .when(overlap["other"] >= IOU_FLOOR, "class_confusion")
        .when(overlap["low"] >= IOU_FLOOR, "score_suppressed")
        .when(overlap["same"] >= 0.1, "same_class_localization")
        .when(overlap["other"] >= 0.1, "wrong_class_partial_overlap")
        .otherwise("no_useful_saved_detection")
    )
    detail = []
    for n in ("same", "other", "low"):
        detail += [
            (-F.col(f"best_{n}.first")).alias(f"{n}_prediction_index"),
            overlap[n].alias(f"{n}_iou"),
            F.col(f"best_{n}.category_id").alias(f"{n}_category_id"),
        ]
    return found.select(*missed.columns, reason.alias("reason"), *detail)


def miss_reasons(explained: DataFrame) -> DataFrame:
    return explained.groupBy("category_id", "reason").agg(F.count("*").alias("n"))


def missed_confusions(explained: DataFrame) -> DataFrame:
    """Which class a missed box was taken for."""
    return (
        explained.filter(F.col("reason") == "class_confusion")
        .groupBy("category_id", F.col("other_category_id").alias("predicted_category_id"))
        .agg(F.count("*").alias("n"))
    )


def size_recall(truth: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """Targets and matched targets per class and short-side bin."""
    used = (
        matches.filter((F.col("score") >= threshold) & F.col("annotation_index").isNotNull())
        .select("image_id", "annotation_index", F.lit(1).alias("hit"))
    )
    return (
        truth.join(used, ["image_id", "annotation_index"], "left")
        .groupBy("category_id", G.size_bin("w", "h").alias("size_bin"))
        .agg(F.count("*").alias("targets"), F.count("hit").alias("matched"))
    )
