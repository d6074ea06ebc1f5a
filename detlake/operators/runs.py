"""Contracts of training runs and frozen releases, as tables of named checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.operators.grouping import differences


def history_checks(history: DataFrame, budget: str = "max_steps", views: str = "training_views") -> DataFrame:
    """Per run: passes numbered 1..n, contiguous steps, complete budget, final validation.

    ``history``: run_id, pass, pass_complete, step_start, step_end, train_steps,
    has_validation, plus the run's budget and view count on every row.
    """
    one = Window.partitionBy("run_id").orderBy("pass")
    rows = history.withColumns(
        {
            "_number": F.row_number().over(one),
            "_before": F.lag("step_end", 1, 0).over(one),
            "_last": F.lead("pass").over(one).isNull(),
        }
    )
    whole = F.ceil(F.col(budget) / F.col(views))
    steps = F.col("step_end") - F.col("step_start") + 1
    return rows.groupBy("run_id").agg(
        F.bool_and(F.col("pass") == F.col("_number")).alias("passes_numbered"),
        F.bool_and(F.col("step_start") == F.col("_before") + 1).alias("steps_contiguous"),
        F.bool_and(F.col("train_steps") == steps).alias("steps_counted"),
        F.bool_and(F.col("pass_complete") == (F.col("train_steps") == F.col(views))).alias(
            "passes_labelled"
        ),
        F.bool_and(F.col("has_validation") == F.col("_last")).alias("validated_at_end_only"),
        (F.max("step_end") == F.max(budget)).alias("budget_met"),
        (F.count("*") == F.max(whole)).alias("passes_complete"),
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch with the best validation AP per run; the earliest wins ties."""
    rest = [c for c in history.columns if c != "run_id"]
    return (
        history.groupBy("run_id")
        .agg(F.max_by(F.struct(*rest), F.struct("ap50_95", (-F.col("epoch")).alias("e"))).alias("b"))
        .select("run_id", "b.*")
    )


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with each named check and ``passed``, true when all hold."""
    named = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return named.withColumn("passed", passed)


def prediction_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Predictions, by position, that two runs do not share."""
    return differences(left, right)


def verify_release(images: DataFrame, assignment: DataFrame, files: DataFrame) -> DataFrame:
    """Images that no longer agree with the frozen release.

    ``assignment``: group_id, frozen_split; ``files``: path, actual_sha256, actual_width,
    actual_height.
    """
    reason = (
        F.when(F.col("frozen_split").isNull(), "group_not_in_release")
        .when(F.col("split") != F.col("frozen_split"), "group_assignment_differs")
        .when(F.col("actual_sha256").isNull(), "file_missing")
        .when(F.col("actual_sha256") != F.col("sha256"), "checksum_mismatch")
        .when(
            (F.col("actual_width") != F.col("width")) | (F.col("actual_height") != F.col("height")),
            "dimension_mismatch",
        )
    )
    return (
        images.join(assignment, "group_id", "left")
        .join(files, "path", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*images.columns, "reason")
    )
