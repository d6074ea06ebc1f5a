"""Data-quality findings as tables, and the report that sums them up.

Every finding is (severity, code, images, n, detail): ``images`` are the paths involved,
``n`` how many times it occurs there. Bad rows are reported, never dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.functions.text import safe_path
from detlake.operators.near import near_links, near_pairs

SPLITS = ["train", "validation", "test"]


def issue(df: DataFrame, severity: str, code: str, *images: str, n=None, detail=None) -> DataFrame:
    return df.select(
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        F.array(*[F.col(i).cast("string") for i in images]).cast("array<string>").alias("images"),
        (F.lit(1) if n is None else n).cast("bigint").alias("n"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def union_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# License and manifest


def license_issues(header: DataFrame, purpose: str, listing: DataFrame) -> DataFrame:
    """``header``: struct license; ``listing``: path, length of the files present."""
    lic = header.select("license.*")
    forbidden = lic.filter(~F.array_contains("allowed_uses", purpose))
    future = lic.filter(F.col("reviewed_on") > F.current_date())
    unsafe = lic.filter(~safe_path("evidence"))
    present = listing.filter(F.col("length") > 0).select(F.col("path").alias("evidence"))
    absent = lic.filter(safe_path("evidence")).join(present, "evidence", "left_anti")
    return union_issues(
        issue(forbidden, "error", "usage_not_permitted"),
        issue(future, "error", "invalid_review_date"),
        issue(unsafe, "error", "unsafe_license_path", detail=F.col("evidence")),
        issue(absent, "error", "missing_license_evidence", detail=F.col("evidence")),
    )


def unknown_class_issues(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    lost = annotations.join(classes.select("class_id"), "class_id", "left_anti")
    return issue(
        lost.groupBy("path").agg(F.count("*").alias("k")), "error", "unknown_class", "path",
        n=F.col("k"),
    )


def out_of_bounds_issues(
    annotations: DataFrame, images: DataFrame, code: str = "out_of_bounds", severity="error"
) -> DataFrame:
    boxes = annotations.join(images.select("path", "width", "height"), "path")
    bad = boxes.filter(~G.xyxy_valid("x1", "y1", "x2", "y2", "width", "height"))
    return issue(
        bad.groupBy("path").agg(F.count("*").alias("k")), severity, code, "path", n=F.col("k")
    )


def duplicate_path_issues(images: DataFrame) -> DataFrame:
    again = images.groupBy("path").agg(F.count("*").alias("k")).filter("k > 1")
    return issue(again, "error", "duplicate_path", "path", n=F.col("k") - 1)


def unsafe_path_issues(images: DataFrame) -> DataFrame:
    return issue(images.filter(~safe_path("path")), "error", "unsafe_path", "path")


# File content


def checksum_issues(images: DataFrame, files: DataFrame) -> DataFrame:
    """``files``: path, actual_sha256. A missing file counts as unreadable."""
    met = images.drop("actual_sha256").join(
        files.select("path", "actual_sha256"), "path", "left"
    )
    return union_issues(
        issue(
            met.filter(F.col("actual_sha256") != F.col("sha256")),
            "error",
            "checksum_mismatch",
            "path",
        ),
        issue(met.filter(F.col("actual_sha256").isNull()), "error", "image_unreadable", "path"),
    )


def repeats_of_first(df: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """Rows that repeat a key, each with the ``first_path`` seen under it.

    The first row comes from an aggregate, not a window, so that a key shared by very
    many copies is not gathered in one task.
    """
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct("path", "sha256"), order).alias("first"),
        F.min(order).alias("_first"),
        F.count("*").alias("copies"),
    )
    return (
        df.join(firsts.filter("copies > 1"), key)
        .filter(F.col(order) > F.col("_first"))
        .select(*df.columns, F.col("first.path").alias("first_path"),
                F.col("first.sha256").alias("first_sha256"))
    )


def duplicate_byte_issues(files: DataFrame) -> DataFrame:
    """``files``: path, ordinal, sha256 (declared), actual_sha256."""
    again = repeats_of_first(files, "actual_sha256")
    return issue(again, "error", "duplicate_bytes", "first_path", "path")


def duplicate_pixel_issues(files: DataFrame) -> DataFrame:
    """Same pixels in another encoding. ``files`` also has pixel_sha256."""
    again = repeats_of_first(files, "pixel_sha256")
    other = again.filter(F.col("actual_sha256") != F.col("first_sha256"))
    return issue(other, "error", "duplicate_pixels", "first_path", "path")


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """Keys held by several images, with sizes and the splits they touch."""
    per_split = df.groupBy(key, "split").agg(F.count("*").alias("n"))
    return (
        per_split.groupBy(key)
        .agg(
            F.sum("n").alias("images"),
            F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"),
            (F.count("*") > 1).alias("crosses_splits"),
        )
        .filter("images > 1")
    )


def dimension_issues(images: DataFrame, decoded: DataFrame, severity: str = "error") -> DataFrame:
    actual = decoded.select(
        "path", F.col("width").alias("actual_width"), F.col("height").alias("actual_height")
    )
    differ = images.drop("actual_width", "actual_height").join(actual, "path").filter(
        (F.col("actual_height") > 0)
        & ((F.col("width") != F.col("actual_width")) | (F.col("height") != F.col("actual_height")))
    )
    return issue(differ, severity, "dimension_mismatch", "path")


def visual_leakage_issues(images: DataFrame, k: int = 4) -> DataFrame:
    """Similar thumbnails in different splits. ``images``: ordinal, path, split, signature."""
    named = images.withColumn("image_id", F.col("path"))
    pairs = near_pairs(named, near_links(named, k), identity=None)
    return issue(
        pairs, "review", "possible_visual_leakage", "first_image_id", "second_image_id",
        detail=F.col("distance"),
    )


# Splits and coverage


def split_class_counts(
    images: DataFrame, annotations: DataFrame, classes: DataFrame, splits=SPLITS
) -> DataFrame:
    """Boxes per split and class, with explicit zeros. ``annotations``: path, class_id."""
    counted = (
        annotations.join(images.select("path", "split"), "path")
        .groupBy("split", "class_id")
        .agg(F.count("*").alias("n"))
    )
    frame = classes.select(
        "class_id", "name", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split")
    )
    return frame.join(counted, ["split", "class_id"], "left").select(
        "split", "class_id", "name", F.coalesce("n", F.lit(0)).alias("annotations")
    )


def coverage_issues(counts: DataFrame) -> DataFrame:
    return issue(
        counts.filter("annotations = 0"), "review", "missing_class_coverage",
        detail=F.concat_ws(":", "split", "name"),
    )


def group_leakage_issues(images: DataFrame) -> DataFrame:
    leaking = (
        images.groupBy("group_id").agg(F.count_distinct("split").alias("k")).filter("k > 1")
    )
    return issue(leaking, "error", "group_leakage", detail=F.col("group_id"))


def empty_split_issues(images: DataFrame, splits=SPLITS) -> DataFrame:
    spark = images.sparkSession
    wanted = spark.createDataFrame([(s,) for s in splits], "split string")
    present = images.select("split").distinct()
    return issue(
        wanted.join(present, "split", "left_anti"), "error", "empty_split", detail=F.col("split")
    )


# COCO and YOLO audits


def reference_errors(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations that name an unknown image or category; must be empty to go on."""
    no_image = annotations.join(images.select("split", "image_id"), ["split", "image_id"], "left_anti")
    no_class = annotations.join(
        categories.select("split", "category_id"), ["split", "category_id"], "left_anti"
    )
    return no_image.withColumn("reason", F.lit("unknown_image")).unionByName(
        no_class.withColumn("reason", F.lit("unknown_category"))
    )


def resolved_annotations(
    annotations: DataFrame, images: DataFrame, categories: DataFrame
) -> DataFrame:
    return annotations.join(images, ["split", "image_id"]).join(
        categories.withColumnRenamed("name", "category"), ["split", "category_id"]
    )


def coco_issues(resolved: DataFrame) -> DataFrame:
    """Repeated ids, invalid boxes and repeated boxes of one image."""
    ids = (
        resolved.groupBy("split", "annotation_id")
        .agg(F.count("*").alias("k"), F.min("file").alias("file"))
        .filter("k > 1")
    )
    four = F.size("bbox") == 4
    invalid = resolved.filter(
        ~F.coalesce(four, F.lit(False))
        | ~G.coco_box_valid("x", "y", "w", "h", "width", "height")
    )
    boxes = (
        resolved.groupBy("split", "file", "category_id", *"xywh")
        .agg(F.count("*").alias("k"))
        .filter("k > 1")
        .groupBy("split", "file")
        .agg(F.sum(F.col("k") - 1).alias("k"))
    )
    return union_issues(
        issue(ids, "issue", "duplicate_annotation_id", "file", n=F.col("k") - 1,
              detail=F.col("annotation_id")),
        issue(invalid, "issue", "invalid_box", "file", detail=F.col("annotation_id")),
        issue(boxes, "issue", "duplicate_box", "file", n=F.col("k")),
    )


def missing_label_issues(images: DataFrame, label_files: DataFrame) -> DataFrame:
    """``images``: path, label_path; ``label_files``: label_path."""
    lost = images.join(label_files.select("label_path").distinct(), "label_path", "left_anti")
    return issue(lost, "issue", "missing_label", "path")


def yolo_line_issues(parsed: DataFrame) -> DataFrame:
    bad = parsed.filter(F.col("issue").isNotNull())
    return bad.select(
        F.lit("issue").alias("severity"),
        F.col("issue").alias("code"),
        F.array("label_path").alias("images"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("line_number").cast("string").alias("detail"),
    )


def byte_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files present in two encodings of a dataset whose bytes differ."""
    return (
        left.select("split", "file", F.col("sha256").alias("left_sha256"))
        .join(right.select("split", "file", F.col("sha256").alias("right_sha256")), ["split", "file"])
        .filter(F.col("left_sha256") != F.col("right_sha256"))
    )


def class_map_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    from detlake.operators.grouping import differences

    return differences(found.select("category_id", "name"), expected.select("category_id", "name"))


def remap_classes(annotations: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Map source classes; excluded ones are marked, unmapped ones get status ``unmapped``.

    ``taxonomy``: source, source_category_id, class_id (NULL when excluded).
    """
    known = taxonomy.withColumn("_known", F.lit(True))
    status = (
        F.when(F.col("_known").isNull(), "unmapped")
        .when(F.col("class_id").isNull(), "excluded")
        .otherwise("mapped")
    )
    return (
        annotations.join(known, ["source", "source_category_id"], "left")
        .withColumn("status", status)
        .drop("_known")
    )


# Border corrections


def border_corrections(annotations: DataFrame, images: DataFrame, tolerance=G.BORDER_TOLERANCE) -> DataFrame:
    """Annotations with the status, reason and result of a bounded border correction."""
    boxes = annotations.join(images.select("image_id", "width", "height"), "image_id")
    return boxes.withColumn(
        "fix", G.border_correction("x", "y", "w", "h", "width", "height", tolerance)
    )


def correction_proposals(corrected: DataFrame) -> DataFrame:
    return corrected.filter("fix.status = 'corrected'").select(
        "image_id", "annotation_index", "category_id",
        *[F.col(c).alias(f"before_{c}") for c in "xywh"],
        *[F.col(f"fix.{c}").alias(f"after_{c}") for c in "xywh"],
    )


def unnormalizable(corrected: DataFrame) -> DataFrame:
    return corrected.filter("fix.status = 'unnormalizable'").select(
        "image_id", "annotation_index", "category_id", F.col("fix.reason").alias("reason")
    )


# Report


def validation_summary(issues: DataFrame, samples: int) -> DataFrame:
    """One row: valid has no error, ready_for_training has no finding at all."""
    bad: Column = F.col("severity") == "error"
    return issues.agg(
        (F.count_if(bad) == 0).alias("valid"),
        (F.count("*") == 0).alias("ready_for_training"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(~bad, F.col("n"))), F.lit(0)).alias("reviews"),
    ).withColumn("sample_count", F.lit(samples).cast("bigint"))


def validate_dataset(
    manifest,
    files: DataFrame,
    decoded: DataFrame,
    listing: DataFrame,
    header_issues: DataFrame | None = None,
    purpose: str = "research",
) -> DataFrame:
    """All findings of a manifest and its files.

    ``files``: path, actual_sha256; ``decoded``: fingerprints with path, width, height,
    pixel_sha256, ahash; ``listing``: path, length.
    """
    images, annotations, classes = manifest.images, manifest.annotations, manifest.classes
    known = annotations.join(classes.select("class_id"), "class_id", "left_semi")
    content = images.join(files.select("path", "actual_sha256"), "path").join(
        decoded.select("path", "pixel_sha256", F.get("ahash", F.lit(0)).alias("signature")),
        "path",
        "left",
    )
    parts = [
        license_issues(manifest.header, purpose, listing),
        unknown_class_issues(annotations, classes),
        out_of_bounds_issues(known, images),
        duplicate_path_issues(images),
        unsafe_path_issues(images),
        checksum_issues(images, files),
        duplicate_byte_issues(content),
        duplicate_pixel_issues(content),
        dimension_issues(images, decoded),
        visual_leakage_issues(content.filter(F.col("signature").isNotNull())),
        group_leakage_issues(images),
        empty_split_issues(images),
        coverage_issues(split_class_counts(images, known, classes)),
    ]
    if header_issues is not None:
        parts.append(issue(header_issues, "error", "image_unreadable", "path", detail=F.col("reason")))
    return union_issues(*parts)
