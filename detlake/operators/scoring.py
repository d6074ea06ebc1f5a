"""Detector plug-in, display policy and report assembly."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake import schemas

# Fixed values of the display policy.
DISPLAY_THRESHOLD = 0.70
EXPERIMENTAL_THRESHOLD = 0.25
HIGH_CONFIDENCE = 0.90
DISPLAY_POLICY = "provisional-1"
EXPERIMENTAL_POLICY = "portfolio-display-0.25-v1"
FAILED_CODE = "INFERENCE_FAILED"
CRITICAL_TYPES = ["solder_bridge", "missing_component"]
DEFECT_TYPES = [
    "short", "spur", "spurious_copper", "open", "mouse_bite", "hole_breakout",
    "conductor_scratch", "conductor_foreign_object", "base_material_foreign_object",
    "missing_component", "misaligned_component", "solder_bridge", "damaged_component",
    "board_damage", "foreign_object", "contamination",
]

Detector = Callable[[pd.DataFrame], pd.DataFrame]


class NoDetections:
    """Stand-in for a model: finds nothing, so that everything around it can be run."""

    version = "demo-no-model-0.1.0"  # fixed value: reports of a demo run bear it
    is_demo = True
    is_experimental = False

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            columns=["image_id", "defect_type", "confidence", "x1", "y1", "x2", "y2"]
        )


def checked_artifact(path: str, sha256: str) -> bytes:
    """Model bytes whose digest is pinned; called once per task by a detector factory."""
    with open(path, "rb") as stream:
        body = stream.read()
    if hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError("model artifact differs from its pinned digest")
    return body


def detect(images: DataFrame, factory: Callable[[], Detector] = NoDetections) -> DataFrame:
    """Run a detector over Arrow batches of images; the factory runs once per partition."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for batch in batches:
            yield detector(batch)

    return images.mapInPandas(score, schemas.DETECTIONS)


def detection_issue(width="width", height="height") -> Column:
    from detlake.functions.geometry import finite

    sound = (
        F.col("defect_type").isin(DEFECT_TYPES)
        & F.col("confidence").between(0, 1)
        & finite("confidence", "x1", "y1", "x2", "y2")
        & (F.col("x1") >= 0) & (F.col("y1") >= 0)
        & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    )
    width, height = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    inside = (F.col("x2") <= width) & (F.col("y2") <= height)
    return F.when(~F.coalesce(sound, F.lit(False)), "invalid_detection").when(
        ~inside, "out_of_bounds"
    )


def checked(detections: DataFrame, inspections: DataFrame) -> DataFrame:
    """Detections with ``issue``: null where type, score and box are sound and lie inside the image.

    ``inspections``: image_id, width, height. Boxes of images that are not listed are out of bounds.
    """
    sizes = inspections.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    met = detections.join(sizes, "image_id", "left")
    issue = detection_issue(F.coalesce("_w", F.lit(-1)), F.coalesce("_h", F.lit(-1)))
    return met.withColumn("issue", issue).drop("_w", "_h")


def limitations(is_demo: bool, experimental: bool) -> list[str]:
    """What a reader of a report must know of its limits."""
    if experimental:
        last = "Experimental model, labels not reviewed; its display threshold is not calibrated."
    elif is_demo:
        last = "Demo run without a trained model."
    else:
        last = "Thresholds are provisional until they are calibrated."
    return ["Visual aid only: says nothing of electrical or functional quality.", last]


def inspection_reports(
    inspections: DataFrame,
    detections: DataFrame,
    model_version: str,
    is_demo: bool = False,
    experimental: bool = False,
) -> DataFrame:
    """One row per inspection: a complete report, or the reason why there is none.

    ``inspections``: image_id, width, height, inference_time_ms. One unsound or out-of-bounds
    detection fails the whole inspection: its status is FAILED, with the error code that
    clients see, the first issue and how many detections had one; all else is null. A detector
    answers for one image at a time, so the findings travel inside the report.
    """
    sound = checked(detections, inspections)
    bad = sound.filter(F.col("issue").isNotNull()).groupBy("image_id").agg(
        F.min("issue").alias("issue"), F.count("*").alias("issues")
    )
    failed = F.col("issues").isNotNull()
    made = reports(inspections, decide(sound, experimental).drop("issue"), model_version, is_demo, experimental)
    texts = F.array(*[F.lit(t) for t in limitations(is_demo, experimental)])
    report = {
        "image_width": F.col("width"), "image_height": F.col("height"), "inference_time_ms": F.col("inference_time_ms"),
        "limitations": texts,
        **{c: F.col(c) for c in ("detections", "findings", "ignored_detection_count", "overall_result", "model_version",
                                 "is_demo", "is_experimental", "decision_policy_version")},
    }
    return made.join(bad, "image_id", "left").select(
        "image_id",
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(failed, FAILED_CODE).alias("error_code"),
        "issue",
        F.coalesce("issues", F.lit(0)).alias("issues"),
        *[F.when(~failed, c).alias(n) for n, c in report.items()],
    )


def scored(images: DataFrame, factory: Callable[[], Detector] = NoDetections) -> DataFrame:
    """(image_id, inference_time_ms, found): what a detector finds in each image and how long it takes.

    The detector is called once an image, so that each has a time of its own; ``found`` holds
    that image's detections.
    """
    names = ["defect_type", "confidence", "x1", "y1", "x2", "y2"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for batch in batches:
            rows = []
            for at in range(len(batch)):
                start = time.perf_counter()
                found = detector(batch.iloc[at : at + 1])
                spent = round((time.perf_counter() - start) * 1000)
                rows.append((batch["image_id"].iloc[at], spent, found[names].to_dict("records")))
            yield pd.DataFrame(rows, columns=["image_id", "inference_time_ms", "found"])

    one = ", ".join(f"{n}: {'string' if n == 'defect_type' else 'double'}" for n in names)
    return images.mapInPandas(score, f"image_id string, inference_time_ms long, found array<struct<{one}>>")


def decide(detections: DataFrame, experimental: bool = False) -> DataFrame:
    """Add shown, severity and confidence_band to every detection."""
    threshold = EXPERIMENTAL_THRESHOLD if experimental else DISPLAY_THRESHOLD
    severity = (
        F.lit("medium")
        if experimental
        else F.when(F.col("defect_type").isin(CRITICAL_TYPES), "critical").otherwise("high")
    )
    band = (
        F.lit("review")
        if experimental
        else F.when(F.col("confidence") >= HIGH_CONFIDENCE, "high").otherwise("review")
    )
    shown = F.col("confidence") >= threshold
    return detections.withColumns(
        {
            "shown": shown,
            "severity": F.when(shown, severity),
            "confidence_band": F.when(shown, band),
        }
    )


def reports(
    inspections: DataFrame,
    decided: DataFrame,
    model_version: str,
    is_demo: bool = False,
    experimental: bool = False,
) -> DataFrame:
    """One report per inspection, with its findings, ignored count and overall result.

    The findings travel inside the report: tiled detections are limited to 100 per image
    before they get here.
    """
    finding = F.struct(
        "defect_type", "confidence", "x1", "y1", "x2", "y2", "severity", "confidence_band"
    )
    grouped = decided.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("shown"), finding))).alias("detections"),
        F.count_if(F.col("shown")).alias("findings"),
        F.count_if(~F.col("shown")).alias("ignored_detection_count"),
    )
    result = (
        F.lit("NOT_EVALUATED")
        if is_demo
        else F.when(F.col("findings") > 0, "REVIEW_REQUIRED").otherwise(
            "NO_VISIBLE_DEFECTS_DETECTED"
        )
    )
    policy = EXPERIMENTAL_POLICY if experimental else DISPLAY_POLICY
    return (
        inspections.join(grouped, "image_id", "left")
        .withColumns(
            {
                "findings": F.coalesce("findings", F.lit(0)),
                "ignored_detection_count": F.coalesce("ignored_detection_count", F.lit(0)),
                "detections": F.coalesce(
                    "detections", F.array().cast(grouped.schema["detections"].dataType)
                ),
            }
        )
        .withColumns(
            {
                "overall_result": result,
                "model_version": F.lit(model_version),
                "is_demo": F.lit(is_demo),
                "is_experimental": F.lit(experimental),
                "decision_policy_version": F.lit(policy),
            }
        )
    )
