"""Descriptive statistics of datasets, runs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.operators.running import running_totals


def image_statistics(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images, boxes and empty images per split, per dimension and in total.

    ``level`` is split, dimension or total, ``value`` its name.
    """
    boxes = annotations.groupBy("image_id").agg(F.count("*").alias("boxes"))
    rows = (
        images.join(boxes, "image_id", "left")
        .select(
            "split",
            F.concat_ws("x", "width", "height").alias("dimension"),
            F.coalesce("boxes", F.lit(0)).alias("boxes"),
        )
        .groupBy("split", "dimension")
        .agg(
            F.count("*").alias("images"),
            F.sum("boxes").alias("annotations"),
            F.count_if(F.col("boxes") == 0).alias("empty_images"),
        )
    )
    by_split, by_dimension = F.grouping("split") == 0, F.grouping("dimension") == 0
    return (
        rows.groupingSets([["split"], ["dimension"], []], "split", "dimension")
        .agg(
            F.when(by_split, "split").when(by_dimension, "dimension").otherwise("total").alias("level"),
            F.coalesce("split", "dimension", F.lit("all")).alias("value"),
            F.sum("images").alias("images"),
            F.sum("annotations").alias("annotations"),
            F.sum("empty_images").alias("empty_images"),
        )
        .select("level", "value", "images", "annotations", "empty_images")
    )


def class_statistics(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Boxes and positive images per class; classes without boxes show 0."""
    counted = annotations.groupBy("category_id").agg(
        F.count("*").alias("annotations"), F.count_distinct("image_id").alias("positive_images")
    )
    return categories.join(counted, "category_id", "left").na.fill(
        0, ["annotations", "positive_images"]
    )


def archive_summary(images: DataFrame, annotations: DataFrame, limit: int = 20_000_000) -> DataFrame:
    """Megapixels, luminance, box share of the image, negatives and oversized images.

    ``images``: image_id, width, height, mean_luminance; ``annotations``: image_id and
    xyxy. Only boxes inside their image enter the mean box share.
    """
    pixels = F.col("width").cast("bigint") * F.col("height")
    dims = images.select("image_id", "width", "height")
    valid = G.xyxy_valid("x1", "y1", "x2", "y2", "width", "height")
    fraction = G.area_fraction("x1", "y1", "x2", "y2", "width", "height")
    per_image = (
        annotations.join(dims, "image_id")
        .groupBy("image_id")
        .agg(
            F.count("*").alias("boxes"),
            F.count_if(valid).alias("valid_boxes"),
            F.sum(F.when(valid, fraction)).alias("fractions"),
        )
    )
    return images.join(per_image, "image_id", "left").agg(
        F.count("*").alias("images"),
        F.coalesce(F.sum("boxes"), F.lit(0)).alias("annotations"),
        F.min(pixels / 1e6).alias("megapixels_min"),
        F.max(pixels / 1e6).alias("megapixels_max"),
        F.avg(pixels / 1e6).alias("megapixels_mean"),
        F.avg("mean_luminance").alias("mean_luminance"),
        G.ratio(F.sum("fractions"), F.sum("valid_boxes")).alias("mean_box_fraction"),
        F.count_if(F.col("boxes").isNull()).alias("negative_images"),
        F.count_if(pixels > limit).alias("oversized_images"),
    )


def family_splits(images: DataFrame, splits: list[str]) -> DataFrame:
    """Images of each filename family per split, and whether the family crosses splits."""
    counted = images.groupBy("family").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits],
        F.count_distinct("split").alias("k"),
    )
    return counted.withColumn("crosses_splits", F.col("k") > 1).drop("k")


def latency_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean and interpolated median and 95th percentile, exact for groups of any size.

    Works on counts per distinct value and their running totals, so no group has to fit
    into one task.
    """
    by = by or []
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count("*").alias("_n")
    )
    ranked = running_totals(counted, by, [F.col(value)], {"_upto": F.col("_n")})
    sizes = ranked.groupBy(*by).agg(
        F.sum("_n").alias("_size"), F.sum(F.col("_n") * F.col(value)).alias("_sum")
    )
    if by:
        placed = ranked.join(sizes, by)
    else:
        whole = sizes.first()
        placed = ranked.withColumns({c: F.lit(whole[c]) for c in ("_size", "_sum")})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col(value)))

    marks = {"p50": 0.5, "p95": 0.95}
    ends = []
    for name, share in marks.items():
        place = (F.col("_size") - 1) * share
        ends += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
    found = placed.groupBy(*by).agg(
        F.max("_size").alias("_size"), F.max("_sum").alias("_sum"), *ends
    )

    def between(name: str, share: float) -> Column:
        place = (F.col("_size") - 1) * share
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(
        *by, (F.col("_sum") / F.col("_size")).alias("mean"), *[between(*m) for m in marks.items()]
    )


def run_totals(history: DataFrame) -> DataFrame:
    return history.groupBy("run_id").agg(
        F.count("*").alias("passes"),
        F.sum("train_steps").alias("total_train_steps"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
        F.avg("train_loss").alias("mean_train_loss"),
    )


def class_exposures(steps: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """How often each class was shown over a training order."""
    views = steps.groupBy(key).agg(F.count("*").alias("shown"))
    boxes = annotations.groupBy(key, "category_id").agg(F.count("*").alias("boxes"))
    return boxes.join(views, key).groupBy("category_id").agg(
        F.sum(F.col("shown") * F.col("boxes")).alias("exposures")
    )


def distinct_counts(images: DataFrame) -> DataFrame:
    return images.agg(
        F.count("*").alias("rows"),
        F.count_distinct("image_id").alias("images"),
        F.count_distinct("group_id").alias("groups"),
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; must be empty where keys are identities."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


# Histogram bounds, in seconds, of the request metrics.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "route", "status").agg(F.count("*").alias("requests"))


def latency_histogram(log: DataFrame, bounds=None) -> DataFrame:
    """Cumulative request counts per upper bound, one row per (method, route, bound).

    Bounds without requests of their own still appear; ``le`` is infinity on the last.
    """
    bounds = [*(bounds or LATENCY_BOUNDS), float("inf")]
    counted = log.groupBy("method", "route").agg(
        *[F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.sum("seconds").alias("total_seconds"),
    )
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("requests"))
        for i, b in enumerate(bounds)
    ])
    return counted.select("method", "route", "total_seconds", F.inline(rows))
