"""Review cases, append-only decisions and the states derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.functions.text import bounded_text, record_digest, sorted_entries, zoned_timestamp
from detlake.operators.grouping import differences

# The answers each kind of case accepts, field by field.
ANSWERS = {
    "pair": {
        "alignment": ["confirmed", "rejected", "needs_reference"],
        "normal_clean": ["confirmed", "rejected", "needs_reference"],
        "annotation_completeness": ["confirmed", "rejected", "needs_reference"],
    },
    "near": {"relationship": ["related", "unrelated", "needs_reference"]},
    "box": {"correction": ["accept", "reject", "needs_reference"]},
    "class": {"definition": ["retain_source", "needs_reference"]},
    "source": {"assessment": ["reviewed", "needs_reference"]},
}
# The actions each kind of subject accepts.
ACTIONS = {
    "annotation": ["keep_label", "correct_label", "remove_label", "needs_reference"],
    "prediction": ["add_label", "dismiss_prediction", "needs_reference"],
}
WITH_BOX = ["correct_label", "add_label"]
REVIEWER_LIMIT, RATIONALE_LIMIT = 200, 4000


def _kind_map(values: dict) -> Column:
    return F.create_map(*[part for k, v in values.items() for part in (F.lit(k), v)])


def answer_fields() -> Column:
    """Sorted field names by case kind."""
    return _kind_map({k: F.array(*[F.lit(f) for f in sorted(v)]) for k, v in ANSWERS.items()})


def allowed_answers() -> Column:
    """``kind/field/answer`` of everything that may be answered."""
    return F.array(*[
        F.lit(f"{kind}/{field}/{answer}")
        for kind, fields in ANSWERS.items()
        for field, answers in fields.items()
        for answer in answers
    ])


# Case catalog


def case_catalog(**kinds: DataFrame) -> DataFrame:
    """Union of case tables keyed by ``case_id``; ``kind`` comes from the argument name."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    catalog = parts[0]
    for part in parts[1:]:
        catalog = catalog.unionByName(part, allowMissingColumns=True)
    return catalog


def repeated_cases(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1")


def decision_template(catalog: DataFrame, packet_sha256: str) -> DataFrame:
    """Cases with their answer fields left blank."""
    fields = answer_fields()[F.col("kind")]
    blank = F.transform(fields, lambda f: F.lit(None).cast("string"))
    return catalog.select(
        F.lit(packet_sha256).alias("packet_sha256"),
        "case_id",
        F.map_from_arrays(fields, blank).alias("answers"),
        F.lit(None).cast("string").alias("rationale"),
    )


def search_cases(
    catalog: DataFrame, text: str = "", kind: str | None = None, saved: bool | None = None,
    drafts: DataFrame | None = None, columns: tuple[str, ...] = ("search", "case_id"),
) -> DataFrame:
    """Cases by kind, by whether a draft exists and by text in any named column."""
    found = catalog
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    if text:
        found = found.filter(
            F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(
                text.lower()
            )
        )
    if saved is not None:
        found = found.join(drafts.select("case_id"), "case_id", "left_semi" if saved else "left_anti")
    return found


# Batches


def decision_issues(decisions: DataFrame, catalog: DataFrame, packet_sha256: str) -> DataFrame:
    """Decisions that may not enter the ledger, with the first reason found.

    ``decisions``: batch_hash, packet_sha256, reviewer, reviewed_at, case_id, answers,
    rationale.
    """
    known = decisions.join(catalog.select("case_id", "kind"), "case_id", "left")
    repeats = decisions.groupBy("batch_hash", "case_id").agg(F.count("*").alias("_times"))
    fields = F.array_sort(F.map_keys("answers"))
    wrong = F.filter(
        F.map_entries("answers"),
        lambda e: ~F.coalesce(
            F.array_contains(
                allowed_answers(), F.concat_ws("/", F.col("kind"), e["key"], e["value"])
            ),
            F.lit(False),
        ),
    )
    reason = (
        F.when(F.col("packet_sha256") != packet_sha256, "packet_mismatch")
        .when(~bounded_text("reviewer", REVIEWER_LIMIT), "invalid_reviewer")
        .when(zoned_timestamp("reviewed_at").isNull(), "invalid_review_time")
        .when(F.col("kind").isNull(), "unknown_case")
        .when(F.col("_times") > 1, "repeated_case")
        .when(~bounded_text("rationale", RATIONALE_LIMIT), "invalid_rationale")
        .when(~fields.eqNullSafe(answer_fields()[F.col("kind")]), "wrong_fields")
        .when(F.size(wrong) > 0, "invalid_answer")
    )
    return (
        known.join(repeats, ["batch_hash", "case_id"])
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
    )


def new_batches(decisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Decisions of batches the ledger does not hold yet: importing twice changes nothing."""
    return decisions.join(ledger.select("batch_hash").distinct(), "batch_hash", "left_anti")


def append_batch(
    ledger: DataFrame | None, decisions: DataFrame, catalog: DataFrame, packet_sha256: str,
    parent_sha256: str | None = None,
) -> tuple[DataFrame, bool]:
    """(next ledger snapshot, changed). Refuses invalid decisions and earlier timestamps."""
    if (ledger is None) != (parent_sha256 is None):
        raise ValueError("a previous ledger and its hash go together")
    if not decision_issues(decisions, catalog, packet_sha256).isEmpty():
        raise ValueError("batch contains invalid decisions")
    revision, fresh = 1, decisions
    if ledger is not None:
        fresh = new_batches(decisions, ledger)
        if fresh.isEmpty():
            return ledger, False
        revision = ledger.agg(F.max("revision")).first()[0] + 1
    added = fresh.withColumn("revision", F.lit(revision)).withColumn(
        "parent_sha256", F.lit(parent_sha256).cast("string")
    )
    combined = added if ledger is None else ledger.unionByName(added)
    if not time_violations(combined).isEmpty():
        raise ValueError("updated decisions need a later timestamp")
    return combined, True


# Review states


def time_violations(ledger: DataFrame, revision: str = "revision") -> DataFrame:
    """Decisions of one reviewer on one case that do not carry a later time than before."""
    one = Window.partitionBy("case_id", "reviewer").orderBy(revision)
    at = zoned_timestamp("reviewed_at")
    return ledger.withColumn("_before", F.lag(at).over(one)).filter(at <= F.col("_before")).drop(
        "_before"
    )


def latest_reviews(ledger: DataFrame, revision: str = "revision") -> DataFrame:
    """The current decision per case and reviewer."""
    rest = [c for c in ledger.columns if c not in ("case_id", "reviewer")]
    return (
        ledger.groupBy("case_id", "reviewer")
        .agg(F.max_by(F.struct(*rest), revision).alias("r"))
        .select("case_id", "reviewer", "r.*")
    )


def review_states(catalog: DataFrame, ledger: DataFrame, revision: str = "revision") -> DataFrame:
    """unreviewed, conflicting, needs_reference or recorded, with the agreed answers."""
    answers = F.to_json(sorted_entries("answers"))
    current = (
        latest_reviews(ledger, revision)
        .withColumn("_a", answers)
        .groupBy("case_id")
        .agg(
            F.count("*").alias("reviews"),
            F.min("_a").alias("_low"),
            F.max("_a").alias("_high"),
            F.bool_or(F.array_contains(F.map_values("answers"), "needs_reference")).alias("_ref"),
            F.min_by("answers", "reviewer").alias("answers"),
        )
    )
    status = (
        F.when(F.col("reviews").isNull(), "unreviewed")
        .when(F.col("_low") != F.col("_high"), "conflicting")
        .when(F.col("_ref"), "needs_reference")
        .otherwise("recorded")
    )
    return catalog.join(current, "case_id", "left").withColumns(
        {
            "status": status,
            "reviews": F.coalesce("reviews", F.lit(0)),
            "answers": F.when(status == "recorded", F.col("answers")),
        }
    ).drop("_low", "_high", "_ref")


def replay_differences(catalog: DataFrame, ledger: DataFrame, stored_states: DataFrame) -> DataFrame:
    """Differences between stored states and those recomputed from the history."""
    again = review_states(catalog, ledger).select("case_id", "status", "reviews")
    return differences(again, stored_states.select("case_id", "status", "reviews"))


def chain_breaks(revisions: DataFrame) -> DataFrame:
    """Revisions whose parent is not the revision before. ``revisions``: ledger_id, revision,
    content_sha256, parent_sha256."""
    one = Window.partitionBy("ledger_id").orderBy("revision")
    before = F.lag("content_sha256").over(one)
    number = F.lag("revision", 1, 0).over(one) + 1
    return (
        revisions.withColumns({"_before": before, "_number": number})
        .filter(
            ~F.col("parent_sha256").eqNullSafe(F.col("_before"))
            | (F.col("revision") != F.col("_number"))
        )
        .drop("_before", "_number")
    )


# Notes and adjudication


def note_issues(notes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Notes that do not describe the subject they name, with the first mismatch.

    ``notes`` and ``subjects`` share image, subject_kind, subject_index, source_sha256,
    group_id, category_id, x, y, w, h, score and outcome; ``subjects`` is the reviewed
    source. A prediction can only be noted when it is a false positive.
    """
    keys = ["image", "subject_kind", "subject_index"]
    fields = ["source_sha256", "group_id", "category_id", "x", "y", "w", "h", "score"]
    bound = subjects.select(
        *keys, F.lit(True).alias("_known"), F.col("outcome").alias("_outcome"),
        *[F.col(c).alias(f"_{c}") for c in fields],
    )
    reason = F.when(F.col("_known").isNull(), "unknown_subject")
    for c in fields:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c}_differs")
    prediction = F.col("subject_kind") == "prediction"
    reason = reason.when(prediction & (F.col("_outcome") == "matched"), "not_a_false_positive").when(
        prediction & ~F.col("outcome").eqNullSafe(F.col("_outcome")), "context_differs"
    )
    return (
        notes.join(bound, keys, "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*notes.columns, "reason")
    )


def new_observations(notes: DataFrame, observations: DataFrame) -> DataFrame:
    """Notes a reviewer has not recorded before; equality is on all fields."""
    return notes.join(
        observations.select("case_id", "reviewer", "note_hash").distinct(),
        ["case_id", "reviewer", "note_hash"],
        "left_anti",
    )


def observation_digests(observations: DataFrame) -> DataFrame:
    """What a decision on each case has to have seen: number and digest of observations.

    ``ordinal`` numbers the observations of a case. They are digested in runs of 4096
    ordinals, the runs again in runs of 4096, so a much discussed case is never gathered
    in one task.
    """
    record = F.sha2(F.to_json(F.struct("ordinal", "reviewer", "note_hash")), 256)
    level = observations.select(
        "case_id", F.col("ordinal").cast("bigint").alias("o"), record.alias("d"),
        F.lit(1).cast("bigint").alias("n"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("o", "d")))
    for _ in range(2):
        level = level.groupBy("case_id", F.expr("o div 4096").alias("run")).agg(
            F.sha2(F.array_join(in_order["d"], ","), 256).alias("d"), F.sum("n").alias("n")
        ).withColumnRenamed("run", "o")
    return level.groupBy("case_id").agg(
        F.sum("n").alias("observation_count"),
        F.sha2(F.array_join(in_order["d"], ","), 256).alias("observations_sha256"),
    )


def adjudicate(observations: DataFrame, resolutions: DataFrame, adjudicator: str,
               reviewed_at: str, version: int) -> DataFrame:
    """Decisions bound to the observations that existed when they were taken."""
    return resolutions.join(observation_digests(observations), "case_id").withColumns(
        {
            "adjudicator": F.lit(adjudicator),
            "reviewed_at": F.lit(reviewed_at),
            "version": F.lit(version),
        }
    )


def resolution_issues(resolutions: DataFrame, cases: DataFrame, classes: int) -> DataFrame:
    """Resolutions that do not fit their case.

    ``cases``: case_id, subject_kind, width, height; ``resolutions``: case_id, action,
    class_id, x1..y2 (NULL where no annotation is given).
    """
    allowed = F.array(*[F.lit(f"{k}/{a}") for k, v in ACTIONS.items() for a in v])
    known = resolutions.join(cases.select("case_id", "subject_kind", "width", "height"), "case_id", "left")
    times = resolutions.groupBy("case_id").agg(F.count("*").alias("_times"))
    boxed = F.col("class_id").isNotNull()
    fits = F.col("class_id").between(0, classes - 1) & G.xyxy_valid(
        "x1", "y1", "x2", "y2", "width", "height"
    )
    reason = (
        F.when(F.col("subject_kind").isNull(), "unknown_case")
        .when(F.col("_times") > 1, "repeated_case")
        .when(
            ~F.array_contains(allowed, F.concat_ws("/", "subject_kind", "action")),
            "action_not_applicable",
        )
        .when(F.col("action").isin(WITH_BOX) != boxed, "annotation_presence")
        .when(boxed & ~F.coalesce(fits, F.lit(False)), "annotation_out_of_bounds")
    )
    return (
        known.join(times, "case_id")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*resolutions.columns, "reason")
    )


def adjudication_status(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """pending until the latest decision has seen all observations of its case."""
    seen = observations.groupBy("case_id").agg(F.count("*").alias("observations"))
    last = decisions.groupBy("case_id").agg(
        F.max_by(F.struct("action", "observation_count"), "version").alias("last")
    )
    current = F.col("last.observation_count") == F.col("observations")
    status = (
        F.when(~F.coalesce(current, F.lit(False)), "pending")
        .when(F.col("last.action") == "needs_reference", "needs_reference")
        .otherwise("resolved")
    )
    return seen.join(last, "case_id", "left").select(
        "case_id", "observations", F.col("last.action").alias("action"), status.alias("status")
    )


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


# Edits


def apply_edits(annotations: DataFrame, edits: DataFrame, additions: DataFrame) -> DataFrame:
    """Replace or delete by original index, then append additions.

    ``edits``: image_id, annotation_index, action (replace, delete) and the new class_id,
    x1..y2. ``origin`` tells kept, replaced and added rows apart.
    """
    box = ["class_id", "x1", "y1", "x2", "y2"]
    changed = edits.select(
        "image_id", "annotation_index", "action", *[F.col(c).alias(f"_{c}") for c in box]
    )
    replaced = F.col("action") == "replace"
    kept = (
        annotations.join(changed, ["image_id", "annotation_index"], "left")
        .filter(~F.col("action").eqNullSafe("delete"))
        .select(
            "image_id",
            "annotation_index",
            *[F.when(replaced, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in box],
            F.when(replaced, "replaced").otherwise("kept").alias("origin"),
        )
    )
    added = additions.select(
        "image_id", F.lit(None).cast("bigint").alias("annotation_index"), *box,
        F.lit("added").alias("origin"),
    )
    return kept.unionByName(added)


def edit_issues(annotations: DataFrame, edits: DataFrame, result: DataFrame) -> DataFrame:
    """Edits without a subject, edits that change nothing, and repeated result boxes."""
    box = ["class_id", "x1", "y1", "x2", "y2"]
    keys = ["image_id", "annotation_index"]
    lost = edits.join(annotations, keys, "left_anti").select("image_id", F.lit("unknown_subject").alias("reason"))
    same = F.lit(True)
    for c in box:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    idle = (
        edits.filter("action = 'replace'")
        .join(annotations.select(*keys, *[F.col(c).alias(f"_{c}") for c in box]), keys)
        .filter(same)
        .select("image_id", F.lit("no_change").alias("reason"))
    )
    twice = (
        result.groupBy("image_id", *box)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("image_id", F.lit("duplicate_annotation").alias("reason"))
    )
    return lost.unionByName(idle).unionByName(twice)


def change_log(annotations: DataFrame, edits: DataFrame, additions: DataFrame) -> DataFrame:
    """Before and after of every change."""
    keys = ["image_id", "annotation_index"]
    box = ["class_id", "x1", "y1", "x2", "y2"]

    def packed(prefix: str) -> Column:
        return F.struct(*[F.col(prefix + c).alias(c) for c in box])

    old = annotations.select(*keys, packed("").alias("before"))
    edited = edits.join(old, keys).select(
        *keys, "action", "before", F.when(F.col("action") == "replace", packed("")).alias("after")
    )
    added = additions.select(
        "image_id", F.lit(None).cast("bigint").alias("annotation_index"), F.lit("add").alias("action"),
        F.lit(None).cast(edited.schema["before"].dataType).alias("before"), packed("").alias("after"),
    )
    return edited.unionByName(added)


def corrected_release(annotations: DataFrame, status: DataFrame, edits: DataFrame,
                      additions: DataFrame) -> DataFrame:
    """Edited annotations, refused while any case is open or any edit is unsound."""
    if status.isEmpty() or not status.filter("status <> 'resolved'").isEmpty():
        raise ValueError("all cases need current resolved decisions")
    if edits.isEmpty() and additions.isEmpty():
        raise ValueError("no corrections to apply")
    result = apply_edits(annotations, edits, additions)
    if not edit_issues(annotations, edits, result).isEmpty():
        raise ValueError("edits are unbound, idle or create duplicates")
    return result


# Exports


def merge_exports(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): a subject with two different values is a conflict."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in values])
    new = incoming.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in values])
    met = old.join(new, keys, "full_outer")
    differ = F.lit(False)
    for c in values:
        differ = differ | ~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    conflict = F.col("_old").isNotNull() & F.col("_new").isNotNull() & differ
    pick = [F.when(F.col("_new").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in values]
    return met.filter(~conflict).select(*keys, *pick), met.filter(conflict).select(*keys)


def worklist(cases: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cases with the boxes of the image they show, one row per box, for export."""
    shown = boxes.select("image_id", "annotation_index", "category_id", *"xywh")
    return cases.join(shown, "image_id", "left")


def note_hash(columns: list[str]) -> Column:
    return record_digest(**{c: c for c in columns})
