"""Links between images, groups, review queues and leakage-free partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from detlake.operators import near
from detlake.operators.components import connected_components
from detlake.session import stored


def pair_images(defects: DataFrame, normals: DataFrame) -> DataFrame:
    """Full outer pairing of defect and normal images by (pair_key, split).

    ``status`` is paired, missing_normal, missing_defect or not_one_to_one. Both sides
    carry image_id, pair_key and split.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pair_key", "split").agg(
            F.min("image_id").alias(f"{name}_image_id"), F.count("*").alias(f"{name}s")
        )

    status = (
        F.when(F.col("normals").isNull(), "missing_normal")
        .when(F.col("defects").isNull(), "missing_defect")
        .when((F.col("defects") > 1) | (F.col("normals") > 1), "not_one_to_one")
        .otherwise("paired")
    )
    return (
        side(defects, "defect")
        .join(side(normals, "normal"), ["pair_key", "split"], "full_outer")
        .withColumn("status", status)
    )


def star_links(df: DataFrame, key: str, reason: str, node: str = "image_id") -> DataFrame:
    """Link every member of a key to its smallest one: a star, never all pairs."""
    hubs = df.groupBy(key).agg(F.min(node).alias("src"))
    return (
        df.join(hubs, key)
        .filter(F.col(node) != F.col("src"))
        .select("src", F.col(node).alias("dst"), F.lit(reason).alias("reason"))
    )


def build_links(images: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Links by filename pair and by identical pixels."""
    links = star_links(images, "pixel_sha256", "identical_decoded_pixels")
    if pairs is None:
        return links
    named = pairs.filter(F.col("status") == "paired").select(
        F.col("defect_image_id").alias("src"),
        F.col("normal_image_id").alias("dst"),
        F.lit("source_filename_pair").alias("reason"),
    )
    return named.unionByName(links)


def assign_groups(images: DataFrame, links: DataFrame) -> DataFrame:
    """Images with the component their links put them in."""
    labels = connected_components(links, nodes=images.select("image_id"))
    return images.join(
        labels.select(F.col("node").alias("image_id"), F.col("component").alias("group_id")),
        "image_id",
    )


def group_summary(members: DataFrame) -> DataFrame:
    """Per group: size, splits it touches and whether it crosses splits."""
    per_split = members.groupBy("group_id", "split").agg(F.count("*").alias("n"))
    return per_split.groupBy("group_id").agg(
        F.sum("n").alias("images"),
        F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"),
        (F.count("*") > 1).alias("crosses_splits"),
    )


def partition_violations(members: DataFrame, listed: DataFrame) -> DataFrame:
    """Images in no group or in more than one."""
    sizes = listed.groupBy("image_id").agg(F.count_distinct("group_id").alias("groups"))
    found = members.select("image_id").join(sizes, "image_id", "full_outer")
    return found.withColumn("groups", F.coalesce("groups", F.lit(0))).filter("groups <> 1")


def with_reviewed_links(links: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Add pairs that a reviewer called related."""
    related = reviewed.filter(F.col("relationship") == "related").select(
        "src", "dst", F.lit("reviewed_related_capture").alias("reason")
    )
    return links.unionByName(related)


def contradictions(members: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pairs called unrelated that nevertheless share a group."""
    group = members.select("image_id", "group_id")
    apart = reviewed.filter(F.col("relationship") == "unrelated")
    return (
        apart.join(group.toDF("src", "src_group"), "src")
        .join(group.toDF("dst", "dst_group"), "dst")
        .filter(F.col("src_group") == F.col("dst_group"))
    )


def review_queue(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Near-duplicate pairs with a flag for those that other evidence already links."""
    group = members.select("image_id", "group_id")
    return (
        pairs.join(group.toDF("first_image_id", "first_group"), "first_image_id")
        .join(group.toDF("second_image_id", "second_group"), "second_image_id")
        .withColumn("already_linked", F.col("first_group") == F.col("second_group"))
        .drop("first_group", "second_group")
    )


def checked_queue(images: DataFrame, links: DataFrame, audited: int) -> DataFrame:
    """The review queue by signature, written once, if its pairs are as many as the audit counted.

    The count is observed while the queue is written; a queue of another length is refused.
    """
    seen = Observation("queue")
    queue = near.signature_queue(images, links).observe(seen, F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    written = stored(queue, "review-queue")
    if seen.get["pairs"] != audited:
        raise ValueError(f"near-duplicate count differs from the audit: {seen.get['pairs']}, not {audited}")
    return written


def quarantine(images: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """Training images near another split, or in a group that crosses splits.

    Works from near signatures, so a mass of copies needs no pair list. ``images``:
    image_id, split, signature, pixel_sha256; ``groups``: image_id, group_id.
    """
    train = images.filter(F.col("split") == "train")
    others = images.filter(F.col("split") != "train")
    # A signature near a held-out one with other pixels taints its training images. The
    # smallest and largest pixel digest tell whether any held-out digest differs.
    spread = others.groupBy("signature").agg(
        F.min("pixel_sha256").alias("low"), F.max("pixel_sha256").alias("high")
    )
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tainted = (
        both.distinct()
        .join(spread.withColumnRenamed("signature", "b"), "b")
        .groupBy(F.col("a").alias("signature"))
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    near = train.join(tainted, "signature").filter(
        (F.col("low") != F.col("pixel_sha256")) | (F.col("high") != F.col("pixel_sha256"))
    )
    crossing = group_summary(groups.join(images.select("image_id", "split"), "image_id")).filter(
        "crosses_splits"
    )
    linked = groups.join(crossing.select("group_id"), "group_id", "left_semi")
    return (
        near.select("image_id")
        .union(train.join(linked, "image_id", "left_semi").select("image_id"))
        .distinct()
    )


def without(images: DataFrame, excluded: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(excluded.select(key), key, "left_anti")


def shared_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values on both sides, such as pixel digests that must not cross partitions."""
    return left.select(column).intersect(right.select(column))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, both ways; empty when they are equal."""
    columns = left.columns
    return (
        left.exceptAll(right.select(*columns))
        .withColumn("only_in", F.lit("left"))
        .unionByName(
            right.select(*columns).exceptAll(left).withColumn("only_in", F.lit("right"))
        )
    )
