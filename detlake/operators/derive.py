"""Review packets and the candidate data derived from uncontested reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.functions.text import stable_id
from detlake.operators import grouping, near, review, validate


@dataclass
class Packet:
    members: DataFrame
    links: DataFrame
    groups: DataFrame
    pair_cases: DataFrame
    near_cases: DataFrame
    box_cases: DataFrame
    class_cases: DataFrame | None = None
    source_cases: DataFrame | None = None
    #: Whether all case ids are ``stable_id`` of their kind.
    stable_ids: bool = False

    def cases(self) -> DataFrame:
        """The catalog in the order of its ids."""
        if not self.stable_ids:
            return in_id_order(self.catalog(), "case_id")
        # Ids travel as 32 bytes, which have the order of their hexadecimal digits, beside the kind.
        digest = F.unhex(F.substring_index("case_id", "-", -1))
        placed = in_id_order(self.catalog().withColumn("case_id", digest), "kind", "case_id")
        return placed.withColumn("case_id", F.concat("kind", F.lit("-"), F.lower(F.hex("case_id"))))

    def catalog(self) -> DataFrame:
        """Cases of all kinds that the packet has, in no order; ``in_id_order`` writes them in theirs."""
        kinds = {"pair": self.pair_cases, "near": self.near_cases, "box": self.box_cases,
                 "class": self.class_cases, "source": self.source_cases}
        return review.case_catalog(**{kind: df for kind, df in kinds.items() if df is not None})

    def summary(self) -> DataFrame:
        """Counts of members, groups, links and cases by name."""
        parts = [
            self.members.agg(F.lit("images").alias("what"), F.count("*").alias("n")),
            self.groups.agg(F.lit("groups"), F.count_distinct("group_id")),
            grouping.group_summary(self.groups).agg(
                F.lit("cross_split_groups"), F.count_if("crosses_splits")
            ),
            self.links.groupBy(F.concat(F.lit("link:"), "reason")).count(),
            self.pair_cases.agg(F.lit("pair_cases"), F.count("*")),
            self.near_cases.agg(F.lit("near_cases"), F.count("*")),
            self.box_cases.agg(F.lit("box_cases"), F.count("*")),
        ]
        for name, cases in (("class_cases", self.class_cases), ("source_cases", self.source_cases)):
            if cases is not None:
                parts.append(cases.agg(F.lit(name), F.count("*")))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole


# What must be reviewed once for each source.
SOURCE_TOPICS = ["rights_and_provenance", "source_grouping_and_split_review"]


def class_cases(categories: DataFrame) -> DataFrame:
    """One case for each category of each source: does its definition hold for the project?

    ``categories``: source, category_id, name.
    """
    return categories.select("source", "category_id", "name").distinct().withColumn(
        "case_id", stable_id("class", "source", "category_id")
    )


def source_cases(sources: DataFrame) -> DataFrame:
    """The cases that each source has as a whole. ``sources``: source."""
    topics = F.explode(F.array(*[F.lit(t) for t in SOURCE_TOPICS])).alias("topic")
    return sources.select("source").distinct().select("source", topics).withColumn(
        "case_id", stable_id("source", "source", "topic")
    )


def in_id_order(df: DataFrame, *ids: str) -> DataFrame:
    """Rows dealt and sorted by their ids, so that files written from them are in one order."""
    return df.repartitionByRange(*ids).sortWithinPartitions(*ids)


def build_packet(
    images: DataFrame, annotations: DataFrame, pairs: DataFrame | None = None, k: int = 2,
    width: int = 64, categories: DataFrame | None = None,
) -> Packet:
    """``images``: image_id, ordinal, split, signature, pixel_sha256, width, height.

    With ``categories`` (source, category_id, name) the packet has class and source cases too.
    """
    links = grouping.build_links(images, pairs)
    groups = grouping.assign_groups(images, links)
    # Images bring their groups along: pairs, which may be very many, are not joined with them.
    close = near.near_pairs(groups, near.near_links(images, k, width), carry=("group_id",))
    queue = close.withColumn("already_linked", F.col("first_group_id") == F.col("second_group_id"))
    if pairs is None:
        pair_cases = links.limit(0).select(
            F.lit("").alias("case_id"), F.col("src").alias("first"), F.col("dst").alias("second")
        )
    else:
        pair_cases = pairs.filter("status = 'paired'").select(
            stable_id("pair", "defect_image_id", "normal_image_id").alias("case_id"),
            F.col("defect_image_id").alias("first"),
            F.col("normal_image_id").alias("second"),
        )
    first, second = F.least("first_image_id", "second_image_id"), F.greatest(
        "first_image_id", "second_image_id"
    )
    near_cases = queue.select(
        stable_id("near", first, second).alias("case_id"),
        first.alias("first"),
        second.alias("second"),
        "distance",
        "already_linked",
    )
    proposals = validate.correction_proposals(validate.border_corrections(annotations, images))
    box_cases = proposals.withColumn("case_id", stable_id("box", "image_id", "annotation_index"))
    packet = Packet(images, links, groups, pair_cases, near_cases, box_cases, stable_ids=True)
    if categories is not None:
        packet.class_cases, packet.source_cases = class_cases(categories), source_cases(categories)
    return packet


def inventory_differences(inventory: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """Images missing on one side, or differing in any field, of packet and inventory."""
    a = inventory.select("image_id", F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in fields])
    b = members.select("image_id", F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in fields])
    reason = F.when(F.col("_a").isNull(), "not_in_inventory").when(
        F.col("_b").isNull(), "not_in_packet"
    )
    for c in fields:
        reason = reason.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c}_differs")
    return (
        a.join(b, "image_id", "full_outer")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("image_id", "reason")
    )


def proposal_mismatches(proposals: DataFrame, annotations: DataFrame) -> DataFrame:
    """Proposals whose before-values are not those of the source annotation."""
    keys = ["image_id", "annotation_index"]
    source = annotations.select(
        *keys, F.lit(True).alias("_known"), F.col("category_id").alias("_category"),
        *[F.col(c).alias(f"_{c}") for c in "xywh"],
    )
    differ = F.col("_known").isNull() | (F.col("category_id") != F.col("_category"))
    for c in "xywh":
        differ = differ | ~F.col(f"before_{c}").eqNullSafe(F.col(f"_{c}"))
    return proposals.join(source, keys, "left").filter(differ).select(*keys)


def apply_corrections(annotations: DataFrame, box_states: DataFrame) -> DataFrame:
    """Annotations with the accepted, uncontested corrections applied.

    ``box_states``: box cases with ``status`` and ``answers``.
    """
    accepted = box_states.filter(
        (F.col("status") == "recorded") & (F.col("answers")["correction"] == "accept")
    ).select("image_id", "annotation_index", *[f"after_{c}" for c in "xywh"], F.lit(True).alias("corrected"))
    return (
        annotations.join(accepted, ["image_id", "annotation_index"], "left")
        .withColumn("corrected", F.coalesce("corrected", F.lit(False)))
        .withColumns({c: F.when(F.col("corrected"), F.col(f"after_{c}")).otherwise(F.col(c)) for c in "xywh"})
        .drop(*[f"after_{c}" for c in "xywh"])
    )


@dataclass
class Candidate:
    annotations: DataFrame
    groups: DataFrame
    new_links: DataFrame
    blockers: DataFrame
    invalid_boxes: DataFrame


def derive_candidate(packet: Packet, annotations: DataFrame, ledger: DataFrame) -> Candidate:
    """Apply uncontested reviews; whatever stands in the way becomes a blocker row."""
    states = review.review_states(packet.catalog(), ledger)
    open_cases = states.filter("status <> 'recorded'").select(
        "case_id", F.col("status").alias("reason")
    )
    answered = states.filter("status = 'recorded'")
    near_answers = answered.filter("kind = 'near'").select(
        "case_id", F.col("first").alias("src"), F.col("second").alias("dst"),
        F.col("answers")["relationship"].alias("relationship"),
    )
    links = grouping.with_reviewed_links(packet.links, near_answers)
    groups = grouping.assign_groups(packet.members, links)
    rejected_pairs = answered.filter(
        (F.col("kind") == "pair")
        & F.exists(F.map_values("answers"), lambda a: a != "confirmed")
    ).select("case_id", F.lit("pair_review_rejected").alias("reason"))
    boxes = states.filter("kind = 'box'")
    rejected_boxes = boxes.filter(
        (F.col("status") == "recorded") & (F.col("answers")["correction"] != "accept")
    ).select("case_id", F.lit("border_correction_rejected").alias("reason"))
    conflicts = grouping.contradictions(groups, near_answers).select(
        "case_id", F.lit("unrelated_conflicts_with_group_links").alias("reason")
    )
    corrected = apply_corrections(annotations, boxes)
    sized = corrected.join(packet.members.select("image_id", "width", "height"), "image_id")
    invalid = sized.filter(~G.coco_box_valid("x", "y", "w", "h", "width", "height"))
    return Candidate(
        corrected,
        groups,
        near_answers.filter("relationship = 'related'"),
        open_cases.unionByName(rejected_pairs).unionByName(rejected_boxes).unionByName(conflicts),
        invalid.select("image_id", "annotation_index"),
    )
