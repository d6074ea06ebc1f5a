"""Operating points, board routing and the global threshold frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.operators.errors import _at, error_counts
from detlake.operators.running import running_totals

# Reporting thresholds and precision floors.
DIAGNOSTIC_THRESHOLDS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)
PRECISION_FLOORS = (0.5, 0.8, 0.9, 0.95)


def boards(images: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per image: number of labels and the score at which it becomes flagged."""
    labels = truth.groupBy("image_id").agg(F.count("*").alias("labels"))
    tops = predictions.groupBy("image_id").agg(F.max("score").alias("top_score"))
    return (
        images.select("image_id", "group_id")
        .join(labels, "image_id", "left")
        .join(tops, "image_id", "left")
        .withColumn("labels", F.coalesce("labels", F.lit(0)))
    )


def board_routing(board_rows: DataFrame, thresholds=DIAGNOSTIC_THRESHOLDS) -> DataFrame:
    """Flagged, escaped and falsely flagged boards, overall and per group.

    ``group_id`` is NULL on the overall rows.
    """
    positive = F.col("labels") > 0
    flagged = F.coalesce(F.col("top_score") >= F.col("score_threshold"), F.lit(False))
    counted = (
        board_rows.withColumn("score_threshold", F.explode(_at(thresholds)))
        .groupingSets(
            [["score_threshold"], ["score_threshold", "group_id"]], "score_threshold", "group_id"
        )
        .agg(
            F.count("*").alias("boards"),
            F.count_if(positive).alias("positive_boards"),
            F.count_if(~positive).alias("empty_boards"),
            F.count_if(flagged).alias("flagged_boards"),
            F.count_if(positive & ~flagged).alias("escaped_boards"),
            F.count_if(~positive & flagged).alias("empty_boards_flagged"),
        )
    )
    return counted.withColumns(
        {
            "flagged_fraction": G.ratio("flagged_boards", "boards"),
            "escape_rate": G.ratio("escaped_boards", "positive_boards"),
            "empty_flag_rate": G.ratio("empty_boards_flagged", "empty_boards"),
        }
    )


def operating_points(
    truth: DataFrame, matches: DataFrame, thresholds=DIAGNOSTIC_THRESHOLDS
) -> DataFrame:
    return error_counts(
        truth, matches, {"micro": [], "class": ["category_id"]}, thresholds
    ).drop("image_id")


def candidate_thresholds(matches: DataFrame) -> DataFrame:
    """Every score that changes the retained set, and always 0 and 1."""
    fixed = matches.sparkSession.createDataFrame([(0.0,), (1.0,)], "score_threshold double")
    return matches.select(F.col("score").alias("score_threshold")).union(fixed).distinct()


def frontier(truth: DataFrame, matches: DataFrame, board_rows: DataFrame) -> DataFrame:
    """Counts at every distinct global threshold; equal scores enter together.

    ``matches`` must be those of ``truth``, and ``board_rows`` list every board.
    """
    taken = F.col("outcome") == "matched"
    zero = F.lit(0).cast("bigint")
    steps = (
        matches.groupBy(F.col("score").alias("score_threshold"))
        .agg(F.count_if(taken).alias("tp"), F.count_if(~taken).alias("fp"))
        .withColumns({"flagged": zero, "positives": zero})
    )
    entries = (
        board_rows.filter(F.col("top_score").isNotNull())
        .groupBy(F.col("top_score").alias("score_threshold"))
        .agg(F.count("*").alias("flagged"), F.count_if(F.col("labels") > 0).alias("positives"))
        .withColumns({"tp": zero, "fp": zero})
    )
    ends = matches.sparkSession.createDataFrame(
        [(0.0, 0, 0, 0, 0), (1.0, 0, 0, 0, 0)],
        "score_threshold double, tp bigint, fp bigint, flagged bigint, positives bigint",
    )
    merged = (
        steps.unionByName(entries)
        .unionByName(ends)
        .groupBy("score_threshold")
        .agg(*[F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "flagged", "positives")])
    )
    totals = running_totals(
        merged,
        [],
        [F.desc("score_threshold")],
        {c: F.col(f"_{c}") for c in ("tp", "fp", "flagged", "positives")},
    )
    labels = truth.count()
    positive = board_rows.filter(F.col("labels") > 0).count()
    return G.with_rates(
        totals.select(
            "score_threshold",
            "tp",
            "fp",
            (F.lit(labels) - F.col("tp")).alias("fn"),
            F.col("flagged").alias("flagged_boards"),
            (F.lit(positive) - F.col("positives")).alias(
                "positive_boards_without_flag"
            ),
        )
    )


def best_at_precision(points: DataFrame, floors=PRECISION_FLOORS) -> DataFrame:
    """Highest-recall point per precision floor; ties: fewer fp, then higher threshold."""
    reached = F.filter(_at(floors), lambda f: F.col("precision") >= f)
    order = F.struct(
        F.coalesce("recall", F.lit(0.0)).alias("r"), (-F.col("fp")).alias("f"), "score_threshold"
    )
    kept = [c for c in points.columns]
    return (
        points.withColumn("precision_floor", F.explode(reached))
        .groupBy("precision_floor")
        .agg(F.max_by(F.struct(*kept), order).alias("best"))
        .select("precision_floor", "best.*")
    )


def highest_zero_escape(points: DataFrame) -> DataFrame:
    """Highest threshold at which no labelled board goes unflagged; NULL without labels."""
    labelled = (F.col("tp") + F.col("fn")) > 0
    return points.agg(
        F.max(
            F.when(labelled & (F.col("positive_boards_without_flag") == 0), F.col("score_threshold"))
        ).alias("score_threshold")
    )
