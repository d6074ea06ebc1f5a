"""Box arithmetic as column expressions. ``xywh`` and ``xyxy`` are in pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND_EPSILON = 1e-6  # slack of the COCO-style bound checks
BORDER_TOLERANCE = 0.02  # largest overshoot, in pixels, that may be corrected


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(*values) -> Column:
    """Every value is present, not NaN and not infinite."""
    ok = F.lit(True)
    for value in map(col, values):
        ok = ok & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))
    return F.coalesce(ok, F.lit(False))


def xywh_to_xyxy(x, y, w, h) -> list[Column]:
    x, y, w, h = map(col, (x, y, w, h))
    return [x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")]


def xyxy_to_xywh(x1, y1, x2, y2) -> list[Column]:
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return [x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")]


def yolo_to_xyxy(cx, cy, w, h, width, height) -> list[Column]:
    """Normalised centre form to pixel corners."""
    cx, cy, w, h, width, height = map(col, (cx, cy, w, h, width, height))
    return [
        ((cx - w / 2) * width).alias("x1"),
        ((cy - h / 2) * height).alias("y1"),
        ((cx + w / 2) * width).alias("x2"),
        ((cy + h / 2) * height).alias("y2"),
    ]


def coco_box_valid(x, y, w, h, width, height, epsilon: float = BOUND_EPSILON) -> Column:
    x, y, w, h, width, height = map(col, (x, y, w, h, width, height))
    inside = (
        (x >= 0) & (y >= 0) & (w > 0) & (h > 0)
        & (x + w <= width + epsilon) & (y + h <= height + epsilon)
    )
    return finite(x, y, w, h) & F.coalesce(inside, F.lit(False))


def xyxy_valid(x1, y1, x2, y2, width, height) -> Column:
    """Strict bounds: no epsilon."""
    x1, y1, x2, y2, width, height = map(col, (x1, y1, x2, y2, width, height))
    inside = (x1 >= 0) & (x1 < x2) & (x2 <= width) & (y1 >= 0) & (y1 < y2) & (y2 <= height)
    return finite(x1, y1, x2, y2) & F.coalesce(inside, F.lit(False))


def intersection(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    ax, ay, aw, ah, bx, by, bw, bh = map(col, (ax, ay, aw, ah, bx, by, bw, bh))
    across = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    down = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return across * down


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two xywh boxes; 0 where the union is not positive."""
    shared = intersection(ax, ay, aw, ah, bx, by, bw, bh)
    union = col(aw) * col(ah) + col(bw) * col(bh) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def area_fraction(x1, y1, x2, y2, width, height) -> Column:
    x1, y1, x2, y2, width, height = map(col, (x1, y1, x2, y2, width, height))
    return (x2 - x1) * (y2 - y1) / F.nullif(width * height, F.lit(0))


def size_bin(w, h) -> Column:
    side = F.least(col(w), col(h))
    return (
        F.when(side < 4, "<4px").when(side < 8, "4-8px").when(side < 16, "8-16px")
        .otherwise(">=16px")
    )


def ratio(numerator, denominator) -> Column:
    """NULL where the denominator is zero: an undefined rate is never reported as 0."""
    return col(numerator) / F.nullif(col(denominator), F.lit(0))


def with_rates(df: DataFrame) -> DataFrame:
    """Add precision and recall to rows holding tp, fp and fn."""
    return df.withColumns(
        {
            "precision": ratio("tp", F.col("tp") + F.col("fp")),
            "recall": ratio("tp", F.col("tp") + F.col("fn")),
        }
    )


def border_correction(x, y, w, h, width, height, tolerance: float = BORDER_TOLERANCE) -> Column:
    """Clip an xywh box that leaves the image by at most ``tolerance`` pixels.

    Struct of ``status`` (unchanged, corrected, unnormalizable), ``reason`` and the
    resulting box. Boxes that may not be corrected keep their original numbers.
    """
    if not (math.isfinite(tolerance) and 0 <= tolerance <= BORDER_TOLERANCE):
        raise ValueError("tolerance must lie between 0 and 0.02 pixels")
    x, y, w, h, width, height = map(col, (x, y, w, h, width, height))
    right, bottom = x + w, y + h
    usable = finite(x, y, w, h, width.cast("double"), height.cast("double")) & (
        (w > 0) & (h > 0) & (width > 0) & (height > 0)
    )
    overshoot = F.greatest(F.lit(0.0), -x, -y, right - width, bottom - height)
    left_in, top_in = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    right_in = F.least(width.cast("double"), right)
    bottom_in = F.least(height.cast("double"), bottom)
    inside = (x >= 0) & (y >= 0) & (right <= width) & (bottom <= height)
    reason = (
        F.when(~usable, "invalid_box_or_dimensions")
        .when(overshoot > tolerance, "exceeds_border_tolerance")
        .when((right_in <= left_in) | (bottom_in <= top_in), "clipping_erases_box")
    )
    corrected = reason.isNull() & ~inside
    return F.struct(
        F.when(reason.isNotNull(), "unnormalizable")
        .when(inside, "unchanged")
        .otherwise("corrected")
        .alias("status"),
        reason.alias("reason"),
        F.when(corrected, left_in).otherwise(x).alias("x"),
        F.when(corrected, top_in).otherwise(y).alias("y"),
        F.when(corrected, right_in - left_in).otherwise(w).alias("w"),
        F.when(corrected, bottom_in - top_in).otherwise(h).alias("h"),
    )


def clamp_to_image(x1, y1, x2, y2, width, height) -> list[Column]:
    x1, y1, x2, y2, width, height = map(col, (x1, y1, x2, y2, width, height))

    def hold(value: Column, limit: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), limit.cast("double"))

    return [
        hold(x1, width).alias("x1"),
        hold(y1, height).alias("y1"),
        hold(x2, width).alias("x2"),
        hold(y2, height).alias("y2"),
    ]


def zero_escape_sample_size(max_rate, confidence=0.95) -> Column:
    """Boards needed, with no escape seen, to bound the escape rate at ``max_rate``."""
    rate = col(max_rate) if isinstance(max_rate, (str, Column)) else F.lit(float(max_rate))
    level = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    usable = finite(rate, level) & (rate > 0) & (rate < 1) & (level > 0) & (level < 1)
    size = F.ceil(F.log1p(-level) / F.log1p(-rate))
    return F.when(usable, size).otherwise(
        F.raise_error(F.lit("rates and confidence must lie strictly between zero and one"))
    )
