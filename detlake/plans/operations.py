"""Scoring, review, run, job and stream queries.

Every query reads its whole tables. Conditions on remainders plant the defects a query has
to find (a missing row, a changed value); they never shorten the work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.functions import text as X
from detlake.functions.sql import register_sql
from detlake.operators import derive as Y
from detlake.operators import jobs as J
from detlake.operators import review as W
from detlake.operators import runs as U
from detlake.operators import scoring as P
from detlake.plans import tables as T
from detlake.plans.registry import query, rounded
from detlake.plans.tables import BASE_SQL
from detlake.streaming import events as E

# Scoring

_TYPES = ["short", "spur", "open", "mouse_bite", "solder_bridge", "missing_component"]
_TYPE_SQL = str(_TYPES)
_DET_SQL = f"""WITH det AS (SELECT l_orderkey AS image_id, ({_TYPE_SQL})[l_partkey % 6 + 1] AS defect_type,
  CAST((l_partkey*7 + l_suppkey*13) % 101 AS DOUBLE) / 100 AS confidence FROM lineitem)
"""


def _detections(spark, d):
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    return T.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.get(kinds, (F.col("l_partkey") % 6).cast("int")).alias("defect_type"),
        F.expr("CAST((l_partkey*7 + l_suppkey*13) % 101 AS DOUBLE) / 100").alias("confidence"),
        *[F.expr(e).alias(n) for n, e in {
            "x1": "CAST((l_partkey*37) % 560 AS DOUBLE)", "y1": "CAST((l_partkey*53) % 400 AS DOUBLE)",
            "x2": "CAST((l_partkey*37) % 560 + 16 AS DOUBLE)", "y2": "CAST((l_partkey*53) % 400 + 16 AS DOUBLE)",
        }.items()],
    )


@query(
    "display_decisions",
    _DET_SQL + "SELECT defect_type, confidence >= 0.7 AS shown, CASE WHEN confidence >= 0.7 THEN CASE WHEN defect_type IN"
    " ('solder_bridge', 'missing_component') THEN 'critical' ELSE 'high' END ELSE 'none' END AS severity,"
    " CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'review' ELSE 'none' END AS band,"
    " count(*) AS n FROM det GROUP BY ALL",
)
def display_decisions(spark, d):
    decided = P.decide(_detections(spark, d))
    return decided.groupBy(
        "defect_type", "shown", F.coalesce("severity", F.lit("none")).alias("severity"),
        F.coalesce("confidence_band", F.lit("none")).alias("band"),
    ).agg(F.count("*").alias("n"))


@query(
    "reports",
    _DET_SQL + "SELECT o_orderkey AS image_id, coalesce(count_if(confidence >= 0.7), 0)::BIGINT AS findings, coalesce(count_if(confidence < 0.7), 0)::BIGINT"
    " AS ignored_detection_count, CASE WHEN count_if(confidence >= 0.7) > 0 THEN 'REVIEW_REQUIRED' ELSE"
    " 'NO_VISIBLE_DEFECTS_DETECTED' END AS overall_result FROM orders LEFT JOIN det ON image_id = o_orderkey GROUP BY 1",
)
def reports(spark, d):
    inspections = T.images(spark, d).select("image_id")
    rows = P.reports(inspections, P.decide(_detections(spark, d)), "model-1")
    return rows.select("image_id", "findings", "ignored_detection_count", "overall_result")


@query(
    "detector_batches",
    "SELECT count(*) AS images, count(*) AS detections FROM part",
)
def detector_batches(spark, d):
    """A plug-in detector that reports one box per image."""
    def one_box():
        def predict(batch):
            return batch.assign(defect_type="open", confidence=0.8, x1=0.0, y1=0.0, x2=1.0, y2=1.0)

        return predict

    images = T.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("image_id"))
    found = P.detect(images, one_box)
    return found.agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("detections"))


@query(
    "sql_functions",
    f"WITH {BASE_SQL} SELECT p_class AS category_id, round(sum(iou), 5) AS sum_iou, count(*) AS n,"
    " sum(bit_count(xor(p_class, t_class)))::BIGINT AS bits FROM iou_pairs GROUP BY 1",
)
def sql_functions(spark, d):
    register_sql(spark)
    T.truth(spark, d).createOrReplaceTempView("detlake_truth")
    T.predictions(spark, d).createOrReplaceTempView("detlake_predictions")
    return spark.sql(
        "SELECT p.category_id, round(sum(iou(p.x, p.y, p.w, p.h, t.x, t.y, t.w, t.h)), 5) AS sum_iou,"
        " count(*) AS n, sum(CAST(hamming(p.category_id, t.category_id) AS BIGINT)) AS bits"
        " FROM detlake_predictions p JOIN detlake_truth t ON p.image_id = t.image_id"
        " WHERE p.x < t.x + t.w AND t.x < p.x + p.w AND p.y < t.y + t.h AND t.y < p.y + p.h"
        " AND box_valid(p.x, p.y, p.w, p.h, 640D, 480D) GROUP BY p.category_id"
    )


# Review

_LEDGER_SQL = """WITH led AS (SELECT conv_id AS case_id, role AS reviewer, turn AS revision, CASE length(text) % 4 WHEN 0 THEN
  'needs_reference' WHEN 1 THEN 'unrelated' ELSE 'related' END AS answer, length(text) % 5 AS late FROM conversations),
cur AS (SELECT case_id, reviewer, arg_max(answer, revision) AS answer FROM led GROUP BY 1, 2),
cat AS (SELECT c_custkey AS case_id FROM customer),
st AS (SELECT case_id, count(*) AS reviews, CASE WHEN count(DISTINCT answer) > 1 THEN 'conflicting'
  WHEN count_if(answer = 'needs_reference') > 0 THEN 'needs_reference' ELSE 'recorded' END AS status FROM cur GROUP BY 1),
states AS (SELECT case_id, coalesce(reviews, 0) AS reviews, coalesce(status, 'unreviewed') AS status
  FROM cat LEFT JOIN st USING (case_id))
"""


def _ledger(spark, d):
    return T.read(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"),
        F.col("role").alias("reviewer"),
        F.col("turn").alias("revision"),
        F.expr("concat('2026-01-0', turn + 1, 'T00:00:0', length(text) % 5, 'Z')").alias("reviewed_at"),
        F.expr(
            "map('relationship', CASE length(text) % 4 WHEN 0 THEN 'needs_reference' WHEN 1 THEN 'unrelated'"
            " ELSE 'related' END)"
        ).alias("answers"),
        F.col("text").alias("rationale"),
        F.sha2(F.concat_ws("/", "conv_id", "turn"), 256).alias("batch_hash"),
        F.lit("packet").alias("packet_sha256"),
    )


def _catalog(spark, d):
    return T.read(spark, d, "customer").select(
        F.col("c_custkey").alias("case_id"), F.lit("near").alias("kind"), F.col("c_name").alias("search")
    )


@query("review_states", _LEDGER_SQL + "SELECT * FROM states")
def review_states(spark, d):
    states = W.review_states(_catalog(spark, d), _ledger(spark, d))
    return states.select("case_id", "reviews", "status")


@query("review_status_counts", _LEDGER_SQL + "SELECT status, count(*) AS n FROM states GROUP BY 1")
def review_status_counts(spark, d):
    return W.status_counts(W.review_states(_catalog(spark, d), _ledger(spark, d)))


@query("latest_reviews", _LEDGER_SQL + "SELECT case_id, reviewer, answer FROM cur")
def latest_reviews(spark, d):
    return W.latest_reviews(_ledger(spark, d)).select(
        "case_id", "reviewer", F.col("answers")["relationship"].alias("answer")
    )


@query(
    "review_time_violations",
    "WITH t AS (SELECT conv_id, role, turn, (turn % 3) * 10 + length(text) % 5 AS tm FROM conversations),"
    " l AS (SELECT *, lag(tm) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM t)"
    " SELECT conv_id AS case_id, role AS reviewer, turn AS revision FROM l WHERE tm <= b",
)
def review_time_violations(spark, d):
    stamp = "concat('2026-01-0', turn % 3 + 1, 'T00:00:0', length(text) % 5, 'Z')"
    ledger = _ledger(spark, d).withColumn("reviewed_at", F.expr(stamp.replace("turn", "revision").replace("text", "rationale")))
    return W.time_violations(ledger).select("case_id", "reviewer", "revision")


@query(
    "replay_differences",
    _LEDGER_SQL + "SELECT case_id, 'left' AS only_in FROM states WHERE case_id % 50 = 0 UNION ALL"
    " SELECT case_id, 'right' FROM states WHERE case_id % 50 = 0",
)
def replay_differences(spark, d):
    states = W.review_states(_catalog(spark, d), _ledger(spark, d))
    broken = states.withColumn("reviews", F.col("reviews") + F.when(F.col("case_id") % 50 == 0, 1).otherwise(0))
    return W.replay_differences(_catalog(spark, d), _ledger(spark, d), broken).select("case_id", "only_in")


@query(
    "decision_issues",
    "SELECT CASE WHEN role = 'system' THEN 'invalid_reviewer' WHEN turn % 5 = 4 THEN 'invalid_review_time' WHEN conv_id % 3 = 0"
    " THEN 'unknown_case' WHEN length(text) > 4000 OR trim(text) = '' THEN 'invalid_rationale' WHEN turn % 5 = 3 THEN 'wrong_fields'"
    " ELSE 'invalid_answer' END AS reason, count(*) AS n FROM conversations WHERE role = 'system' OR turn % 5 = 4 OR conv_id % 3 = 0"
    " OR length(text) > 4000 OR trim(text) = '' OR turn % 5 >= 2 GROUP BY 1",
)
def decision_issues(spark, d):
    decisions = _ledger(spark, d).withColumns(
        {
            "reviewer": F.when(F.col("reviewer") == "system", F.lit("  ")).otherwise(F.col("reviewer")),
            "reviewed_at": F.when(
                F.col("revision") % 5 == 4, F.lit("2026-01-01T00:00:00")
            ).otherwise(F.col("reviewed_at")),
            "answers": F.when(
                F.col("revision") % 5 == 3, F.create_map(F.lit("correction"), F.lit("accept"))
            )
            .when(F.col("revision") % 5 == 2, F.create_map(F.lit("relationship"), F.lit("maybe")))
            .otherwise(F.col("answers")),
        }
    )
    found = W.decision_issues(decisions, _catalog(spark, d).filter("case_id % 3 <> 0"), "packet")
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "new_batches",
    "SELECT conv_id AS case_id, turn AS revision FROM conversations WHERE turn >= 2",
)
def new_batches(spark, d):
    ledger = _ledger(spark, d)
    return W.new_batches(ledger, ledger.filter("revision < 2")).select("case_id", "revision")


@query(
    "chain_breaks",
    "WITH r AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 + CASE WHEN conv_id % 10 = 0 THEN 100 ELSE 0 END END AS parent,"
    " lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id AS ledger_id, turn + 1 AS revision FROM r"
    " WHERE parent IS DISTINCT FROM before OR turn <> coalesce(before + 1, 0)",
)
def chain_breaks(spark, d):
    revisions = T.read(spark, d, "conversations").select(
        F.col("conv_id").alias("ledger_id"),
        (F.col("turn") + 1).alias("revision"),
        F.col("turn").cast("string").alias("content_sha256"),
        F.expr("CASE WHEN turn > 0 THEN CAST(turn - 1 + CASE WHEN conv_id % 10 = 0 THEN 100 ELSE 0 END AS STRING) END").alias(
            "parent_sha256"
        ),
    )
    return W.chain_breaks(revisions).select("ledger_id", "revision")


@query(
    "decision_template",
    "SELECT c_custkey AS case_id, 'relationship' AS field, 'none' AS answer FROM customer",
)
def decision_template(spark, d):
    blank = W.decision_template(_catalog(spark, d), "packet")
    return blank.select("case_id", F.explode("answers").alias("field", "answer")).withColumn(
        "answer", F.coalesce("answer", F.lit("none"))
    )


@query(
    "case_search",
    "SELECT c_custkey AS case_id FROM customer WHERE lower(c_name) LIKE '%#0000001%'"
    " AND c_custkey NOT IN (SELECT conv_id FROM conversations)",
)
def case_search(spark, d):
    drafts = _ledger(spark, d)
    found = W.search_cases(_catalog(spark, d), "CUSTOMER#0000001", "near", saved=False, drafts=drafts)
    return found.select("case_id")


@query(
    "case_catalog",
    "SELECT 'supplier-' || s_suppkey AS case_id, 'pair' AS kind FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, 'class'"
    " FROM nation UNION ALL SELECT 'region-' || r_regionkey, 'source' FROM region",
)
def case_catalog(spark, d):
    def cases(table, key):
        return T.read(spark, d, table).select(F.concat(F.lit(f"{table}-"), F.col(key)).alias("case_id"))

    return W.case_catalog(
        **{"pair": cases("supplier", "s_suppkey"), "class": cases("nation", "n_nationkey"),
           "source": cases("region", "r_regionkey")}
    )


_STATUS_SQL = """WITH ob AS (SELECT conv_id AS case_id, count(*) AS observations FROM conversations GROUP BY 1),
 de AS (SELECT conv_id AS case_id, turn AS version, CASE WHEN length(text) % 3 = 0 THEN 'needs_reference' ELSE 'keep_label' END AS action,
  CASE WHEN length(text) % 2 = 0 THEN n ELSE n - 1 END AS seen FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations
  GROUP BY 1) USING (conv_id) WHERE role = 'assistant'),
 la AS (SELECT case_id, arg_max(action, version) AS action, arg_max(seen, version) AS seen FROM de GROUP BY 1),
 stt AS (SELECT case_id, observations, CASE WHEN seen IS NULL OR seen <> observations THEN 'pending' WHEN action = 'needs_reference'
  THEN 'needs_reference' ELSE 'resolved' END AS status FROM ob LEFT JOIN la USING (case_id))
"""


@query("adjudication_status", _STATUS_SQL + "SELECT * FROM stt")
def adjudication_status(spark, d):
    rows = T.read(spark, d, "conversations")
    observations = rows.select(F.col("conv_id").alias("case_id"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    decisions = rows.filter("role = 'assistant'").join(sizes, "conv_id").select(
        F.col("conv_id").alias("case_id"),
        F.col("turn").alias("version"),
        F.expr("CASE WHEN length(text) % 3 = 0 THEN 'needs_reference' ELSE 'keep_label' END").alias("action"),
        F.expr("CASE WHEN length(text) % 2 = 0 THEN n ELSE n - 1 END").alias("observation_count"),
    )
    return W.adjudication_status(observations, decisions).select("case_id", "observations", "status")


@query(
    "observation_digests",
    "SELECT conv_id AS case_id, count(*) AS observation_count, sha256(sha256(sha256(string_agg(sha256('{\"ordinal\":' || turn ||"
    " ',\"reviewer\":\"' || role || '\",\"note_hash\":\"' || sha256(text) || '\"}'), ',' ORDER BY turn)))) AS observations_sha256"
    " FROM conversations GROUP BY 1",
)
def observation_digests(spark, d):
    rows = T.read(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), F.col("role").alias("reviewer"),
        F.sha2("text", 256).alias("note_hash"),
    )
    return W.observation_digests(rows)


@query(
    "adjudicate",
    "SELECT conv_id AS case_id, count(*) AS observation_count, 'keep_label' AS action FROM conversations GROUP BY 1",
)
def adjudicate(spark, d):
    observations = T.read(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), F.col("role").alias("reviewer"),
        F.sha2("text", 256).alias("note_hash"),
    )
    resolutions = observations.select("case_id").distinct().withColumn(
        "action", F.lit("keep_label")
    )
    decided = W.adjudicate(observations, resolutions, "expert", "2026-01-01T00:00:00Z", 1)
    return decided.select("case_id", "observation_count", "action")


@query(
    "new_observations",
    "SELECT conv_id AS case_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id"
    " AND o.role = c.role AND o.text = c.text AND o.turn < 3)",
)
def new_observations(spark, d):
    notes = T.read(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"), "turn", F.col("role").alias("reviewer"), F.sha2("text", 256).alias("note_hash")
    )
    return W.new_observations(notes, notes.filter("turn < 3")).select("case_id", "turn")


@query(
    "note_issues",
    f"WITH {BASE_SQL} SELECT CASE WHEN prediction_index % 7 = 0 THEN 'unknown_subject' WHEN prediction_index % 7 = 1 THEN 'group_id_differs'"
    " WHEN prediction_index % 7 = 2 THEN 'category_id_differs' WHEN prediction_index % 7 = 3 THEN 'x_differs' WHEN score >= 0.5 THEN"
    " 'not_a_false_positive' END AS reason, count(*) AS n FROM preds JOIN imgs USING (image_id)"
    " WHERE prediction_index % 7 <= 3 OR score >= 0.5 GROUP BY 1",
)
def note_issues(spark, d):
    subjects = T.predictions(spark, d).join(T.images(spark, d).select("image_id", "group_id"), "image_id").select(
        F.col("image_id").alias("image"), F.lit("prediction").alias("subject_kind"),
        F.col("prediction_index").alias("subject_index"), F.lit("h").alias("source_sha256"),
        "group_id", "category_id", *"xywh", "score",
        F.when(F.col("score") >= 0.5, "matched").otherwise("no_overlap").alias("outcome"),
    )
    k = F.col("subject_index") % 7
    notes = subjects.withColumns(
        {
            "group_id": F.when(k == 1, "other").otherwise(F.col("group_id")),
            "category_id": F.when(k == 2, F.col("category_id") + 1).otherwise(F.col("category_id")),
            "x": F.when(k == 3, F.col("x") + 0.5).otherwise(F.col("x")),
        }
    )
    found = W.note_issues(notes, subjects.filter("subject_index % 7 <> 0"))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "resolution_issues",
    f"WITH {BASE_SQL} SELECT CASE WHEN annotation_index % 5 = 0 THEN 'unknown_case' WHEN annotation_index % 5 = 1 THEN 'action_not_applicable'"
    " WHEN annotation_index % 5 = 2 THEN 'annotation_presence' ELSE 'annotation_out_of_bounds' END AS reason, count(*) AS n FROM truth"
    " JOIN imgs USING (image_id) WHERE annotation_index % 5 <= 2 OR category_id - 1 > 2 OR x + 40 + w > 640 GROUP BY 1",
)
def resolution_issues(spark, d):
    boxes = T.truth(spark, d).join(T.images(spark, d), "image_id").withColumn(
        "case_id", F.struct("image_id", "annotation_index")
    )
    cases = boxes.filter("annotation_index % 5 <> 0").select(
        "case_id", F.lit("annotation").alias("subject_kind"), "width", "height"
    )
    k = F.col("annotation_index") % 5
    resolutions = boxes.select(
        "case_id",
        F.when(k == 1, "add_label").otherwise("correct_label").alias("action"),
        F.when(k != 2, F.col("category_id") - 1).alias("class_id"),
        (F.col("x") + 40).alias("x1"), F.col("y").alias("y1"),
        (F.col("x") + 40 + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"),
    )
    found = W.resolution_issues(resolutions, cases, 3)
    return found.groupBy("reason").agg(F.count("*").alias("n"))


def _edits(spark, d):
    boxes = T.truth(spark, d).select(
        "image_id", "annotation_index", (F.col("category_id") - 1).alias("class_id"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"),
        (F.col("y") + F.col("h")).alias("y2"),
    )
    k = F.col("annotation_index") % 11
    edits = boxes.filter(k.isin(1, 2)).select(
        "image_id", "annotation_index", F.when(k == 1, "replace").otherwise("delete").alias("action"),
        "class_id", (F.col("x1") + 1).alias("x1"), "y1", "x2", "y2",
    )
    return boxes, edits, boxes.filter(k == 3).drop("annotation_index").withColumn("class_id", F.lit(4).cast("bigint"))


@query(
    "apply_edits",
    f"WITH {BASE_SQL}, r AS (SELECT category_id - 1 AS class_id, x + CASE WHEN annotation_index % 11 = 1 THEN 1 ELSE 0 END AS x1,"
    " CASE WHEN annotation_index % 11 = 1 THEN 'replaced' ELSE 'kept' END AS origin FROM truth WHERE annotation_index % 11 <> 2"
    " UNION ALL SELECT 4, x, 'added' FROM truth WHERE annotation_index % 11 = 3)"
    " SELECT class_id, origin, count(*) AS n, sum(x1) AS sum_x1 FROM r GROUP BY 1, 2",
)
def apply_edits(spark, d):
    result = W.apply_edits(*_edits(spark, d))
    return result.groupBy("class_id", "origin").agg(F.count("*").alias("n"), F.sum("x1").alias("sum_x1"))


@query(
    "change_log",
    f"WITH {BASE_SQL} SELECT CASE annotation_index % 11 WHEN 1 THEN 'replace' WHEN 2 THEN 'delete' ELSE 'add' END AS action,"
    " count(*) AS n, count_if(annotation_index % 11 <> 3)::BIGINT AS with_before, count_if(annotation_index % 11 <> 2)::BIGINT AS with_after"
    " FROM truth WHERE annotation_index % 11 IN (1, 2, 3) GROUP BY 1",
)
def change_log(spark, d):
    log = W.change_log(*_edits(spark, d))
    return log.groupBy("action").agg(
        F.count("*").alias("n"), F.count("before").alias("with_before"), F.count("after").alias("with_after")
    )


@query(
    "merge_exports",
    "SELECT 'conflict' AS part, count(*) AS n FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'merged', count(*) FROM part"
    " WHERE NOT (p_partkey % 6 = 0)",
)
def merge_exports(spark, d):
    notes = T.read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    mine = notes.filter("p_partkey % 2 = 0 OR p_partkey % 5 = 1")
    theirs = notes.filter("p_partkey % 3 = 0 OR p_partkey % 2 = 1 OR p_partkey % 6 = 4").withColumn(
        "p_size", F.when(F.col("p_partkey") % 6 == 0, -1).otherwise(F.col("p_size"))
    )
    merged, conflicts = W.merge_exports(mine, theirs, ["p_partkey"])
    return merged.agg(F.lit("merged").alias("part"), F.count("*").alias("n")).union(
        conflicts.agg(F.lit("conflict"), F.count("*"))
    )


@query(
    "inventory_differences",
    "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'not_in_inventory' WHEN c_custkey % 10 = 1 THEN 'not_in_packet' ELSE 'segment_differs' END"
    " AS reason, count(*) AS n FROM customer WHERE c_custkey % 10 <= 2 GROUP BY 1",
)
def inventory_differences(spark, d):
    rows = T.read(spark, d, "customer").select(
        F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    changed = rows.withColumn(
        "segment", F.when(F.col("image_id") % 10 == 2, None).otherwise(F.col("segment"))
    )
    found = Y.inventory_differences(
        rows.filter("image_id % 10 <> 0"), changed.filter("image_id % 10 <> 1"), ["name", "segment"]
    )
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "proposal_mismatches",
    f"WITH {BASE_SQL} SELECT image_id, count(*) AS n FROM truth WHERE annotation_index % 9 <= 2 GROUP BY 1",
)
def proposal_mismatches(spark, d):
    truth = T.truth(spark, d)
    k = F.col("annotation_index") % 9
    proposals = truth.select(
        "image_id", "annotation_index",
        (F.col("category_id") + F.when(k == 1, 1).otherwise(0)).alias("category_id"),
        (F.col("x") + F.when(k == 2, 0.5).otherwise(0.0)).alias("before_x"),
        *[F.col(c).alias(f"before_{c}") for c in "ywh"],
    )
    bad = Y.proposal_mismatches(proposals, truth.filter("annotation_index % 9 <> 0"))
    return bad.groupBy("image_id").agg(F.count("*").alias("n"))


@query(
    "apply_corrections",
    f"WITH {BASE_SQL} SELECT category_id, count_if(annotation_index % 4 = 0)::BIGINT AS corrected, sum(CASE WHEN annotation_index % 4 = 0"
    " THEN w - 1 ELSE w END) AS width FROM truth GROUP BY 1",
)
def apply_corrections(spark, d):
    truth = T.truth(spark, d)
    k = F.col("annotation_index") % 4
    states = truth.filter(k < 3).select(
        "image_id", "annotation_index",
        F.col("x").alias("after_x"), F.col("y").alias("after_y"), (F.col("w") - 1).alias("after_w"), F.col("h").alias("after_h"),
        F.when(k == 1, "conflicting").otherwise("recorded").alias("status"),
        F.create_map(F.lit("correction"), F.when(k == 2, "reject").otherwise("accept")).alias("answers"),
    )
    done = Y.apply_corrections(truth, states)
    return done.groupBy("category_id").agg(F.count_if("corrected").alias("corrected"), F.sum("w").alias("width"))


@query(
    "worklist",
    f"WITH {BASE_SQL} SELECT i.image_id, count(t.image_id) AS boxes FROM imgs i LEFT JOIN truth t USING (image_id) GROUP BY 1",
)
def worklist(spark, d):
    rows = W.worklist(T.images(spark, d).select("image_id"), T.truth(spark, d))
    return rows.groupBy("image_id").agg(F.count("annotation_index").alias("boxes"))


# Runs


def _history(spark, d):
    return T.read(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), (F.col("turn") + 1).cast("int").alias("epoch"),
        (F.expr("length(text)") % 100 / 100).alias("ap50_95"), F.expr("length(text)").alias("train_steps"),
        F.expr("CAST(length(text) AS DOUBLE)").alias("elapsed_seconds"), F.lit(1.0).alias("train_loss"),
    )


@query(
    "best_epoch",
    "SELECT conv_id AS run_id, (arg_max(turn, (length(text) % 100, -turn)) + 1)::INT AS epoch, max(length(text) % 100) / 100 AS ap50_95"
    " FROM conversations GROUP BY 1",
)
def best_epoch(spark, d):
    return U.best_epoch(_history(spark, d)).select("run_id", "epoch", "ap50_95")


@query(
    "run_totals",
    "SELECT conv_id AS run_id, count(*) AS passes, sum(length(text))::BIGINT AS total_train_steps, sum(length(text))::DOUBLE AS elapsed_seconds,"
    " 1.0::DOUBLE AS mean_train_loss FROM conversations GROUP BY 1",
)
def run_totals(spark, d):
    from detlake.operators.stats import run_totals as totals

    return totals(_history(spark, d))


@query(
    "history_checks",
    "WITH r AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS m, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b"
    " FROM conversations) SELECT conv_id AS run_id, bool_and(turn = coalesce(b + 1, 0)) AS passes_numbered, bool_and(turn = coalesce(b + 1, 0))"
    " AS steps_contiguous, TRUE AS steps_counted, bool_and(conv_id % 7 <> 0) AS passes_labelled, TRUE AS validated_at_end_only,"
    " (max(turn) + 1) * 10 = (max(m) + 1) * 10 AS budget_met, count(*) = max(m) + 1 AS passes_complete FROM r GROUP BY 1",
)
def history_checks(spark, d):
    rows = T.read(spark, d, "conversations").select("conv_id", "turn")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("m"))
    history = rows.join(last, "conv_id").select(
        F.col("conv_id").alias("run_id"),
        (F.col("turn") + 1).alias("pass"),
        (F.col("conv_id") % 7 != 0).alias("pass_complete"),
        (F.col("turn") * 10 + 1).alias("step_start"),
        (F.col("turn") * 10 + 10).alias("step_end"),
        F.lit(10).alias("train_steps"),
        (F.col("turn") == F.col("m")).alias("has_validation"),
        ((F.col("m") + 1) * 10).alias("max_steps"),
        F.lit(10).alias("training_views"),
    )
    return U.history_checks(history)


@query(
    "contract_gate",
    "SELECT s_suppkey, s_acctbal > 0 AS funded, s_nationkey < 20 AS known, s_acctbal > 0 AND s_nationkey < 20 AS passed FROM supplier",
)
def contract_gate(spark, d):
    rows = T.read(spark, d, "supplier")
    checked = U.gate(rows, {"funded": F.col("s_acctbal") > 0, "known": F.col("s_nationkey") < 20})
    return checked.select("s_suppkey", "funded", "known", "passed")


@query(
    "prediction_differences",
    f"WITH {BASE_SQL} SELECT image_id, score, 'left' AS only_in FROM preds WHERE prediction_index % 50 = 0"
    " UNION ALL SELECT image_id, score + 1, 'right' FROM preds WHERE prediction_index % 50 = 0",
)
def prediction_differences(spark, d):
    left = T.predictions(spark, d)
    right = left.withColumn(
        "score", F.col("score") + F.when(F.col("prediction_index") % 50 == 0, 1.0).otherwise(0.0)
    )
    return U.prediction_differences(left, right).select("image_id", "score", "only_in")


@query(
    "verify_release",
    "WITH i AS (SELECT o_orderkey AS image_id, o_custkey % 13 AS g, o_orderkey % 3 AS split FROM orders)"
    " SELECT image_id, CASE WHEN g = 0 THEN 'group_not_in_release' WHEN g = 1 AND split <> 0 THEN 'group_assignment_differs'"
    " WHEN image_id % 101 = 0 THEN 'file_missing' WHEN image_id % 101 = 1 THEN 'checksum_mismatch' ELSE 'dimension_mismatch' END AS reason"
    " FROM i WHERE g = 0 OR (g = 1 AND split <> 0) OR image_id % 101 <= 2",
)
def verify_release(spark, d):
    images = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 13).alias("g"),
        (F.col("o_orderkey") % 3).alias("split"), F.lit("h").alias("sha256"), F.lit(640).alias("width"), F.lit(480).alias("height"),
    ).withColumn("group_id", F.when(F.col("g") == 1, F.col("g")).otherwise(F.col("g") * 10 + F.col("split") + 100))
    assignment = images.filter("g > 1").select("group_id", F.col("split").alias("frozen_split")).distinct().union(
        spark.createDataFrame([(1, 0)], "group_id bigint, frozen_split bigint")
    )
    k = F.col("image_id") % 101
    files = images.filter(k != 0).select(
        "path", F.when(k == 1, "x").otherwise("h").alias("actual_sha256"),
        F.when(k == 2, 1).otherwise(640).alias("actual_width"), F.lit(480).alias("actual_height"),
    )
    return U.verify_release(images, assignment, files).select("image_id", "reason")


# Jobs

_JOB_SQL = """WITH jobs AS (SELECT o_orderkey AS id, 'u' || (o_custkey % 50) AS owner_id, CASE WHEN o_orderkey % 3 = 0 THEN 'sqs'
  ELSE 'database' END AS queue_backend, CASE o_orderkey % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'COMPLETED'
  ELSE 'FAILED' END AS status, CAST(o_custkey * 10 AS DOUBLE) AS created_at, CAST(o_custkey * 10 + o_orderkey % 7 AS DOUBLE) AS available_at,
  CAST(o_orderkey % 5 AS INT) AS attempts, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey * 10 + 120 AS DOUBLE) END AS lease_until,
  'uploads/' || o_orderkey AS image_key FROM orders)
"""


def _jobs(spark, d):
    return T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("concat('u', o_custkey % 50)").alias("owner_id"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'sqs' ELSE 'database' END").alias("queue_backend"),
        F.expr(
            "CASE o_orderkey % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END"
        ).alias("status"),
        F.expr("CAST(o_custkey * 10 AS DOUBLE)").alias("created_at"),
        F.expr("CAST(o_custkey * 10 + o_orderkey % 7 AS DOUBLE)").alias("available_at"),
        F.expr("CAST(o_orderkey % 5 AS INT)").alias("attempts"),
        F.expr("CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey * 10 + 120 AS DOUBLE) END").alias("lease_until"),
        F.expr("concat('uploads/', o_orderkey)").alias("image_key"),
    )


_DUE = "(status = 'QUEUED' AND available_at <= 9000 OR status = 'PROCESSING' AND lease_until <= 9000)"


@query("claimable_backlog", _JOB_SQL + f"SELECT id, created_at FROM jobs WHERE {_DUE} AND queue_backend = 'sqs' ORDER BY created_at, id LIMIT 40")
def claimable_backlog(spark, d):
    return J.backlog(_jobs(spark, d), 9000, 40, "sqs").select("id", "created_at")


@query(
    "exhausted_jobs",
    _JOB_SQL + f"SELECT id, 'RETRY_LIMIT_EXCEEDED' AS error_code FROM jobs WHERE {_DUE} AND attempts >= 3",
)
def exhausted_jobs(spark, d):
    return J.exhausted(_jobs(spark, d), 9000).select("id", "error_code")


@query(
    "retry_times",
    _JOB_SQL + "SELECT id, created_at + 2 * pow(2, attempts - 1) AS retry_at, created_at + least(300, pow(2, least(attempts * 3, 8))) AS outbox_at"
    " FROM jobs",
)
def retry_times(spark, d):
    rows = _jobs(spark, d).withColumn("tries", F.col("attempts") * 3)
    return rows.select(
        "id", J.retry_at(F.col("created_at")).alias("retry_at"),
        J.outbox_retry_at(F.col("created_at"), "tries").alias("outbox_at"),
    )


@query(
    "owner_history",
    _JOB_SQL + "SELECT id, created_at FROM jobs WHERE owner_id = 'u7' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10",
)
def owner_history(spark, d):
    return J.history(_jobs(spark, d), "u7", 20, 10).select("id", "created_at")


@query(
    "job_lookup",
    _JOB_SQL + "SELECT id, status FROM jobs WHERE id = (SELECT min(o_orderkey) FROM orders WHERE o_custkey % 50 = 7) AND owner_id = 'u7'",
)
def job_lookup(spark, d):
    jobs = _jobs(spark, d)
    first = jobs.filter("owner_id = 'u7'").agg(F.min("id")).first()[0]
    return J.find(jobs, first, "u7").select("id", "status")


_OUTBOX_SQL = _JOB_SQL + """, ob AS (SELECT id + 1000000 AS id, id AS inspection_id, CASE WHEN id % 5 <> 0 THEN created_at END AS published_at,
  created_at AS available_at, CASE WHEN id % 2 = 0 THEN created_at + 50 END AS lease_until FROM jobs),
 ms AS (SELECT event_id + 1000000 AS event_id, event_id AS inspection_id FROM events UNION ALL SELECT event_id + 1000000, event_id FROM events
  WHERE event_id % 6 = 0)
"""


def _outbox(spark, d):
    jobs = _jobs(spark, d)
    return jobs.select(
        (F.col("id") + 1000000).alias("id"), F.col("id").alias("inspection_id"),
        F.when(F.col("id") % 5 != 0, F.col("created_at")).alias("published_at"),
        F.col("created_at").alias("available_at"),
        F.when(F.col("id") % 2 == 0, F.col("created_at") + 50).alias("lease_until"),
    )


def _messages(spark, d):
    once = T.events(spark, d).select(
        (F.col("event_id") + 1000000).alias("event_id"), F.col("event_id").alias("inspection_id")
    )
    return once.union(once.filter("inspection_id % 6 = 0"))


@query(
    "message_jobs",
    _OUTBOX_SQL + "SELECT ms.event_id, j.status FROM ms JOIN ob ON ob.id = ms.event_id AND ob.inspection_id = ms.inspection_id"
    " JOIN jobs j ON j.id = ms.inspection_id AND j.queue_backend = 'sqs'",
)
def message_jobs(spark, d):
    return J.message_jobs(_messages(spark, d), _outbox(spark, d), _jobs(spark, d)).select("event_id", "status")


@query(
    "outbox_pending",
    _OUTBOX_SQL + "SELECT id FROM ob WHERE published_at IS NULL AND available_at <= 9000 AND (lease_until IS NULL OR lease_until <= 9000)",
)
def outbox_pending(spark, d):
    return _outbox(spark, d).filter(J.outbox_pending(9000)).select("id")


@query(
    "reconcile",
    _OUTBOX_SQL + ", m AS (SELECT event_id, count(*) AS n FROM ms GROUP BY 1), r AS (SELECT ob.id AS o, published_at, n, status FROM ob FULL JOIN m"
    " ON m.event_id = ob.id LEFT JOIN jobs ON jobs.id = ob.inspection_id) SELECT CASE WHEN o IS NULL THEN 'unknown_message' WHEN status IS NULL"
    " THEN 'outbox_without_job' WHEN published_at IS NULL AND n IS NULL THEN 'unpublished' WHEN published_at IS NULL THEN 'publish_not_recorded'"
    " WHEN n IS NULL THEN 'published_not_delivered' WHEN status = 'FAILED' THEN 'failed_needs_redrive' WHEN status = 'COMPLETED' THEN 'settled'"
    " ELSE 'in_flight' END AS state, count(*) AS rows, sum(coalesce(n, 0))::BIGINT AS deliveries FROM r GROUP BY 1",
)
def reconcile(spark, d):
    rows = J.reconcile(_outbox(spark, d), _messages(spark, d), _jobs(spark, d))
    return rows.groupBy("state").agg(F.count("*").alias("rows"), F.sum("deliveries").alias("deliveries"))


@query(
    "orphan_objects",
    _JOB_SQL + "SELECT 'uploads/' || event_id AS image_key FROM events WHERE epoch(ts) <= epoch(TIMESTAMP '2024-01-20') - 86400"
    " AND 'uploads/' || event_id NOT IN (SELECT image_key FROM jobs WHERE id % 2 = 0)",
)
def orphan_objects(spark, d):
    objects = T.events(spark, d).select(
        F.concat(F.lit("uploads/"), "event_id").alias("image_key"), F.col("ts").cast("double").alias("modified_at")
    )
    now = F.lit("2024-01-20").cast("timestamp").cast("double")
    return J.orphans(objects, _jobs(spark, d).filter("id % 2 = 0"), now).select("image_key")


_MESSAGE = """CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{"version":2,"event_id":"' || i || '","inspection_id":"' || i || '"}'
 WHEN 2 THEN '{"version":1,"event_id":"' || upper(i) || '","inspection_id":"' || i || '"}'
 WHEN 3 THEN '{"version":1,"event_id":"' || i || '","inspection_id":"' || i || '","owner":"x"}'
 WHEN 4 THEN '{"version":1,"event_id":"' || i || '","inspection_id":"' || i || '","pad":"' || repeat('x', 1024) || '"}'
 ELSE '{"version":1,"event_id":"' || i || '","inspection_id":"' || i || '"}' END"""
_UUID = "'0000abcd-0000-4000-8000-' || lpad(CAST(event_id AS STRING), 12, '0')"


@query(
    "message_issues",
    "SELECT CASE event_id % 6 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'unsupported_version' WHEN 2 THEN 'invalid_identity' WHEN 3 THEN"
    " 'unexpected_keys' WHEN 4 THEN 'oversized' ELSE 'none' END AS issue, count(*) AS n FROM events GROUP BY 1",
)
def message_issues(spark, d):
    bodies = T.events(spark, d).withColumn("i", F.expr(_UUID)).select(F.expr(_MESSAGE).alias("body"))
    return bodies.groupBy(F.coalesce(X.message_issue("body"), F.lit("none")).alias("issue")).agg(F.count("*").alias("n"))


# Streams: each runs to the end of what is available and returns what it wrote.

_KIND = {
    "signup": "inspection_queued", "click": "inspection_processing", "purchase": "inspection_completed",
    "error": "inspection_failed", "view": "inspection_retry_scheduled",
}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"
_STATE_SQL = (
    "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error'"
    " THEN 'FAILED' ELSE 'QUEUED' END"
)


def _event_stream(spark, d):
    schema = T.read(spark, d, "events").schema
    stream = E.read_stream(spark, d, schema, glob="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


_JOB_STATES_SQL = (
    f"SELECT user_id AS inspection_id, arg_max({_STATE_SQL}, (ts, event_id)) AS state, count(*) AS events,"
    " count_if(event_type = 'click')::BIGINT AS attempts FROM events GROUP BY 1"
)


@query("job_states", _JOB_STATES_SQL)
def job_states(spark, d):
    rows = T.events(spark, d).select(
        F.col("user_id").alias("inspection_id"), F.expr(_KIND_SQL).alias("event_type"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("id"),
    )
    return J.job_states(rows).select("inspection_id", "state", "events", "attempts")


@query("job_state_stream", _JOB_STATES_SQL)
def job_state_stream(spark, d):
    rows = _event_stream(spark, d).select(
        F.col("user_id").alias("inspection_id"), F.expr(_KIND_SQL).alias("event_type"), "ts", "event_id"
    )
    updates = E.run_to_table(E.job_state_stream(rows, "60 days"), "states", "update")
    return E.latest_states(updates).select("inspection_id", "state", "events", "attempts")


@query(
    "delivery_dedup_stream",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
)
def delivery_dedup_stream(spark, d):
    events = _event_stream(spark, d)
    resent = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = E.run_to_table(E.without_repeats(resent, "60 days"), "dedup")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "windowed_metrics_stream",
    "SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events"
    " GROUP BY 1, 2",
)
def windowed_metrics_stream(spark, d):
    updates = E.run_to_table(E.windowed_metrics(_event_stream(spark, d), "6 hours"), "windows", "update")
    rest = F.struct("n", "max_value")
    last = updates.groupBy("window_start", "event_type").agg(F.max_by(rest, "batch").alias("r"))
    return last.select(F.col("window_start").cast("bigint").alias("window_start"), "event_type", "r.*")


def _closed(spark, rows, label):
    """``rows`` as a stream that a row of the year 2100 closes, so that all others come out."""
    path = E.scratch_path(spark, label)
    tick = rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    tick = tick.withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    rows.unionByName(tick).write.parquet(path)
    return E.read_stream(spark, path, rows.schema)


@query(
    "queue_age_stream",
    """WITH o AS (SELECT ts, event_id, epoch_us(ts) AS c, 1000000::BIGINT * 3600 * (event_id % 30) + 250000 * (event_id % 4) AS wait FROM events
  WHERE event_type IN ('click', 'view')), a AS (SELECT *, CASE WHEN event_id % 5 <> 0 AND wait <= 86400000000 THEN wait END AS age FROM o)
 SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS window_start, count(*) AS n, count_if(age IS NULL)::BIGINT AS unpublished,
  min(CASE WHEN age IS NULL THEN c END) AS oldest_unpublished, max(age) / 1e6 AS max_age, round(sum(age) / count(age) / 1e6, 6) AS mean_age
 FROM a GROUP BY 1""",
)
def queue_age_stream(spark, d):
    """Clicks and views enter the outbox; four of five are published some hours later, twice each."""
    rows = T.events(spark, d).filter("event_type IN ('click', 'view')").select(
        "ts", "event_id", F.col("user_id").alias("inspection_id")
    )
    wait = F.make_dt_interval(hours=F.col("event_id") % 30, secs=F.col("event_id") % 4 * F.lit(0.25).cast("decimal(18,6)"))
    sent = rows.filter("event_id % 5 <> 0").select((F.col("ts") + wait).alias("ts"), "event_id")
    twice = sent.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    ages = E.queue_ages(_closed(spark, rows, "outbox"), _closed(spark, twice, "sent"), "1 day", "60 days")
    found = E.run_to_table(E.queue_metrics(ages, "6 hours"), "queue")
    return found.select(
        F.col("window_start").cast("bigint").alias("window_start"), "n", "unpublished",
        F.unix_micros("oldest_unpublished").alias("oldest_unpublished"), "max_age", rounded("mean_age", 6),
    )


@query(
    "retries_stream",
    f"""WITH k AS (SELECT ts, user_id, {_KIND_SQL} AS kind FROM events), j AS (SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS window_start,
  user_id, count(*) AS n FROM k WHERE kind = 'inspection_retry_scheduled' GROUP BY ALL)
 SELECT window_start, sum(n)::BIGINT AS retries, count(*) AS jobs, max(n) AS most FROM j GROUP BY 1""",
)
def retries_stream(spark, d):
    rows = T.events(spark, d).select(
        "ts", F.col("user_id").alias("inspection_id"), F.expr(_KIND_SQL).alias("event_type")
    )
    closed = _closed(spark, rows, "retries").fillna({"event_type": "inspection_retry_scheduled"})
    found = E.run_to_table(E.retries_per_window(closed, "6 hours"), "retry-windows")
    return found.select(F.col("window_start").cast("bigint").alias("window_start"), "retries", "jobs", "most")


_COMMAND = {"click": "claim", "purchase": "result", "view": "renew", "error": "redrive", "signup": "fail"}
_COMMAND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMMAND.items()) + " END"
_FENCE_SQL = f"""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch(ts) AS tm, {_COMMAND_SQL} AS kind, max(CASE WHEN event_type = 'click'
  THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM events),
 k AS (SELECT user_id, event_id, kind, tm, tm + 43200 AS lim, CASE WHEN kind = 'claim' THEN event_id WHEN event_id % 4 = 0 THEN -1 ELSE held END
  AS token, row_number() OVER (PARTITION BY user_id ORDER BY tm, CAST(event_id AS VARCHAR)) AS rk FROM c),
 walk(user_id, rk, event_id, token, lim, att, st, outcome) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::DOUBLE, 0, 0, NULL::VARCHAR FROM k UNION ALL
  SELECT user_id, rk, event_id,
   CASE WHEN free AND att < 3 THEN new WHEN free OR (kind IN ('result', 'fail') AND mine) OR (kind = 'redrive' AND st = 3) THEN NULL ELSE old END,
   CASE WHEN (free AND att < 3) OR (kind = 'renew' AND mine) THEN until ELSE lim END,
   CASE WHEN free AND att < 3 THEN att + 1 WHEN kind = 'redrive' AND st = 3 THEN 0 ELSE att END,
   CASE WHEN free THEN CASE WHEN att < 3 THEN 1 ELSE 3 END WHEN kind = 'result' AND mine THEN 2 WHEN kind = 'fail' AND mine
     THEN CASE WHEN att < 3 THEN 0 ELSE 3 END WHEN kind = 'redrive' AND st = 3 THEN 0 ELSE st END,
   CASE kind WHEN 'claim' THEN CASE WHEN NOT free THEN 'claim_refused' WHEN att < 3 THEN 'claimed' ELSE 'retry_limit_exceeded' END
     WHEN 'redrive' THEN CASE WHEN st = 3 THEN 'redriven' ELSE 'stale' END
     ELSE CASE WHEN NOT mine THEN 'stale' WHEN kind = 'renew' THEN 'renewed' WHEN kind = 'result' THEN 'accepted'
       WHEN att < 3 THEN 'retry_scheduled' ELSE 'failed' END END
  FROM (SELECT r.user_id, r.rk, r.event_id, r.kind, r.token AS new, r.lim AS until, s.token AS old, s.lim, s.att, s.st,
    coalesce(s.st = 1 AND s.lim > r.tm AND s.token = r.token, FALSE) AS mine,
    r.kind = 'claim' AND s.st IN (0, 1) AND NOT (s.st = 1 AND s.lim > r.tm) AS free
    FROM walk s JOIN k r ON r.user_id = s.user_id AND r.rk = s.rk + 1))
 SELECT CAST(user_id AS VARCHAR) AS inspection_id, CAST(event_id AS VARCHAR) AS event_id, outcome FROM walk WHERE rk > 0"""


def _commands(spark, d, rows):
    """Clicks claim a lease for twelve hours; all other commands present the token seen last."""
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    claim = F.col("event_type") == "click"
    held = F.max(F.when(claim, F.col("event_id"))).over(before)
    at = F.col("ts").cast("double")
    return rows.select(
        "ts", F.col("user_id").cast("string").alias("inspection_id"), F.col("event_id").cast("string").alias("event_id"),
        F.expr(_COMMAND_SQL).alias("kind"),
        F.when(claim, F.col("event_id")).when(F.col("event_id") % 4 == 0, -1).otherwise(held).cast("string").alias("token"),
        at.alias("at"), (at + 43200).alias("lease_until"),
    )


@query("fenced_results", _FENCE_SQL)
def fenced_results(spark, d):
    verdicts = E.fenced_results_batch(_commands(spark, d, T.events(spark, d)))
    return verdicts.select("inspection_id", "event_id", "outcome")


@query("fenced_results_stream", _FENCE_SQL)
def fenced_results_stream(spark, d):
    """The stateful form: tokens, leases and used attempts are followed per job."""
    commands = _commands(spark, d, T.events(spark, d))
    path = E.scratch_path(spark, "commands")
    commands.write.parquet(path)
    stream = E.read_stream(spark, path, commands.schema)
    verdicts = E.run_to_table(E.fenced_results(stream, "60 days"), "fenced")
    return verdicts.select("inspection_id", "event_id", "outcome")


@query(
    "poison_messages_stream",
    "SELECT CASE event_id % 6 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'unsupported_version' WHEN 2 THEN 'invalid_identity' WHEN 3 THEN"
    " 'unexpected_keys' WHEN 4 THEN 'oversized' ELSE 'accepted' END AS issue, count(*) AS n FROM events GROUP BY 1",
)
def poison_messages_stream(spark, d):
    from detlake.sinks.tables import dead_letters

    bodies = _event_stream(spark, d).withColumn("i", F.expr(_UUID)).select(F.expr(_MESSAGE).alias("body"))
    root = E.scratch_path(spark, "messages")
    stream = E.checked_messages(bodies).writeStream.foreachBatch(dead_letters(root)).option(
        "checkpointLocation", f"{root}/_checkpoint"
    ).trigger(availableNow=True).start()
    stream.awaitTermination()
    schema = "body string, event_id string, inspection_id string"
    good = spark.read.schema(schema).parquet(f"{root}/accepted").select(F.lit("accepted").alias("issue"))
    bad = spark.read.schema(schema + ", issue string").parquet(f"{root}/dead_letters").select("issue")
    return good.union(bad).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "known_messages_stream",
    _OUTBOX_SQL + "SELECT CASE WHEN ob.id IS NULL OR j.id IS NULL THEN 'unknown' WHEN status = 'COMPLETED' THEN 'acknowledge' WHEN status = 'FAILED'"
    " THEN 'retain' ELSE 'process' END AS action, count(*) AS n FROM (SELECT event_id + 1000000 AS event_id, event_id AS inspection_id FROM events) m"
    " LEFT JOIN ob ON ob.id = m.event_id LEFT JOIN jobs j ON j.id = m.inspection_id GROUP BY 1",
)
def known_messages_stream(spark, d):
    messages = _event_stream(spark, d).select(
        (F.col("event_id") + 1000000).alias("event_id"), F.col("event_id").alias("inspection_id")
    )
    found = E.run_to_table(E.known_messages(messages, _outbox(spark, d), _jobs(spark, d)), "known")
    return found.groupBy("action").agg(F.count("*").alias("n"))

