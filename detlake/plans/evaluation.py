"""Matching, metric, diagnosis and qualification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.operators import errors as E
from detlake.operators import matching as M
from detlake.operators import precision as A
from detlake.operators import qualify as Q
from detlake.operators.spatial import overlapping_pairs
from detlake.plans import tables as T
from detlake.plans.registry import long, query, rounded
from detlake.plans.tables import BASE_SQL, MATCH_SQL


def matches(spark, d):
    return M.match_detections(T.truth(spark, d), T.predictions(spark, d))


THRESHOLD_SQL = "(SELECT unnest([0.05, 0.25, 0.5]::DOUBLE[]) AS score_threshold)"
POINT_SQL = "(SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS score_threshold)"


@query(
    "iou_join",
    f"WITH {BASE_SQL} SELECT image_id, p_class, t_class, count(*) AS n,"
    " round(sum(iou), 6) AS sum_iou FROM iou_pairs WHERE iou >= 0.5 GROUP BY ALL",
)
def iou_join(spark, d):
    pairs = overlapping_pairs(T.predictions(spark, d), T.truth(spark, d), ["image_id"])
    return (
        pairs.filter(F.col("iou") >= 0.5)
        .groupBy(
            "image_id",
            F.col("p_category_id").alias("p_class"),
            F.col("t_category_id").alias("t_class"),
        )
        .agg(F.count("*").alias("n"), F.round(F.sum("iou"), 6).alias("sum_iou"))
    )


@query(
    "greedy_matches",
    f"WITH {MATCH_SQL} SELECT image_id, category_id, outcome, count(*) AS n,"
    " count(annotation_index) AS taken, sum(CAST(round(score * 100) AS BIGINT))::BIGINT AS points,"
    " round(sum(iou_any), 6) AS sum_iou FROM matches GROUP BY 1, 2, 3",
)
def greedy_matches(spark, d):
    return matches(spark, d).groupBy("image_id", "category_id", "outcome").agg(
        F.count("*").alias("n"),
        F.count("annotation_index").alias("taken"),
        F.sum(F.round(F.col("score") * 100).cast("bigint")).alias("points"),
        F.round(F.sum("iou_any"), 6).alias("sum_iou"),
    )


@query(
    "greedy_matches_by_rounds",
    f"WITH {MATCH_SQL} SELECT image_id, category_id, outcome, count(*) AS n,"
    " count(annotation_index) AS taken FROM matches GROUP BY 1, 2, 3",
)
def greedy_matches_by_rounds(spark, d):
    """The same matching by the execution reserved for crowded groups."""
    by_rounds = M._matched_by_rounds(T.truth(spark, d), T.predictions(spark, d))
    return (
        by_rounds.withColumn("outcome", M.outcome())
        .groupBy("image_id", "category_id", "outcome")
        .agg(F.count("*").alias("n"), F.count("annotation_index").alias("taken"))
    )


_PROFILE = """
ev AS (SELECT t.score_threshold, m.image_id, m.category_id,
   CASE WHEN outcome = 'matched' THEN 1 ELSE 0 END AS tp,
   CASE WHEN outcome = 'matched' THEN 0 ELSE 1 END AS fp, 0 AS labels
   FROM matches m JOIN {thresholds} t ON m.score >= t.score_threshold
   UNION ALL SELECT t.score_threshold, image_id, category_id, 0, 0, 1 FROM truth, {thresholds} t),
prof AS (SELECT score_threshold,
   CASE WHEN grouping(category_id) = 0 THEN 'class' WHEN grouping(image_id) = 0 THEN 'board'
     ELSE 'micro' END AS level, category_id, image_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
   (sum(labels) - sum(tp))::BIGINT AS fn FROM ev
   GROUP BY GROUPING SETS ((score_threshold), (score_threshold, category_id),
     (score_threshold, image_id)))
"""


@query(
    "error_profile",
    f"WITH {MATCH_SQL}, {_PROFILE.format(thresholds=THRESHOLD_SQL)}"
    " SELECT score_threshold, level, coalesce(category_id, -1) AS category_id,"
    " coalesce(image_id, -1) AS image_id, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision,"
    " round(tp / nullif(tp + fn, 0), 9) AS recall FROM prof",
)
def error_profile(spark, d):
    t = T.truth(spark, d)
    return E.error_profile(t, matches(spark, d)).select(
        "score_threshold",
        "level",
        F.coalesce("category_id", F.lit(-1)).cast("bigint").alias("category_id"),
        F.coalesce("image_id", F.lit(-1)).cast("bigint").alias("image_id"),
        long("tp"),
        long("fp"),
        long("fn"),
        rounded("precision"),
        rounded("recall"),
    )


@query(
    "false_positive_contexts",
    f"WITH {MATCH_SQL} SELECT score_threshold, outcome, count(*) AS n FROM matches"
    f" JOIN {THRESHOLD_SQL} ON score >= score_threshold WHERE outcome <> 'matched' GROUP BY 1, 2",
)
def false_positive_contexts(spark, d):
    return E.false_positive_contexts(matches(spark, d))


@query(
    "false_positive_items",
    f"WITH {MATCH_SQL} SELECT image_id, category_id, score, outcome, round(iou_any, 9) AS iou_any"
    " FROM matches WHERE score >= 0.25 AND outcome = 'class_confusion' AND category_id = 2",
)
def false_positive_items(spark, d):
    items = E.false_positive_items(matches(spark, d), 0.25, 2, "class_confusion")
    return items.select("image_id", "category_id", "score", "outcome", rounded("iou_any"))


@query(
    "board_review_order",
    f"WITH {MATCH_SQL}, fp AS (SELECT image_id, max(score) AS top FROM matches"
    " WHERE score >= 0.25 AND outcome <> 'matched' GROUP BY 1)"
    " SELECT i.image_id, coalesce(top, -1.0::DOUBLE) AS top_score FROM imgs i LEFT JOIN fp USING (image_id)",
)
def board_review_order(spark, d):
    items = E.false_positive_items(matches(spark, d), 0.25)
    return E.board_review_order(T.images(spark, d), items).select("image_id", "top_score")


@query(
    "boards_by_misses",
    f"WITH {MATCH_SQL}, mi AS (SELECT image_id, count(*) AS misses FROM truth t WHERE NOT EXISTS"
    " (SELECT 1 FROM matches m WHERE m.image_id = t.image_id AND m.score >= 0.25"
    "  AND m.annotation_index = t.annotation_index) GROUP BY 1)"
    " SELECT i.image_id, coalesce(misses, 0) AS misses FROM imgs i LEFT JOIN mi USING (image_id)",
)
def boards_by_misses(spark, d):
    missed = M.missed_truth(T.truth(spark, d), matches(spark, d), 0.25)
    return E.boards_by_misses(T.images(spark, d), missed).select("image_id", long("misses"))


@query(
    "target_coverage",
    f"WITH {BASE_SQL}, hit AS (SELECT DISTINCT image_id, annotation_index FROM iou_pairs"
    " WHERE iou >= 0.5 AND score >= 0.25)"
    " SELECT category_id, count(*) AS covered FROM truth SEMI JOIN hit"
    " USING (image_id, annotation_index) GROUP BY 1",
)
def target_coverage(spark, d):
    covered = M.target_coverage(T.truth(spark, d), T.predictions(spark, d), 0.25)
    return covered.groupBy("category_id").agg(F.count("*").alias("covered"))


@query(
    "best_overlaps",
    f"WITH {BASE_SQL}, b AS (SELECT image_id, prediction_index, max(iou) AS iou,"
    " arg_max(t_class, (iou, -annotation_index)) AS cls FROM iou_pairs GROUP BY 1, 2)"
    " SELECT p.category_id, coalesce(b.cls, 0) AS best_class, count(*) AS n,"
    " round(sum(coalesce(b.iou, 0)), 5) AS sum_iou FROM preds p LEFT JOIN b"
    " USING (image_id, prediction_index) GROUP BY 1, 2",
)
def best_overlaps(spark, d):
    truth = T.truth(spark, d)
    best = E.best_overlaps(T.predictions(spark, d), truth, "prediction_index", "annotation_index")
    named = truth.select(
        "image_id",
        F.col("annotation_index").alias("best_index"),
        F.col("category_id").alias("best_class"),
    )
    return (
        best.join(named, ["image_id", "best_index"], "left")
        .groupBy("category_id", F.coalesce("best_class", F.lit(0)).alias("best_class"))
        .agg(F.count("*").alias("n"), F.round(F.sum("best_iou"), 5).alias("sum_iou"))
    )


_MISS_SQL = f"""WITH {MATCH_SQL},
missed AS (SELECT * FROM truth t WHERE NOT EXISTS (SELECT 1 FROM matches m
   WHERE m.image_id = t.image_id AND m.score >= 0.25 AND m.annotation_index = t.annotation_index)),
ov AS (SELECT image_id, annotation_index,
   max(iou) FILTER (score >= 0.25 AND p_class = t_class) AS same,
   max(iou) FILTER (score >= 0.25 AND p_class <> t_class) AS other,
   max(iou) FILTER (score < 0.25 AND p_class = t_class) AS low,
   arg_max(p_class, (iou, score, -prediction_index)) FILTER (score >= 0.25 AND p_class <> t_class)
     AS other_class FROM iou_pairs GROUP BY 1, 2),
why AS (SELECT m.*, other_class, CASE WHEN coalesce(same, 0) >= 0.5 THEN 'matching_competition'
   WHEN coalesce(other, 0) >= 0.5 THEN 'class_confusion'
   WHEN coalesce(low, 0) >= 0.5 THEN 'score_suppressed'
   WHEN coalesce(same, 0) >= 0.1 THEN 'same_class_localization'
   WHEN coalesce(other, 0) >= 0.1 THEN 'wrong_class_partial_overlap'
   ELSE 'no_useful_saved_detection' END AS reason
   FROM missed m LEFT JOIN ov USING (image_id, annotation_index))
"""


def _explained(spark, d):
    p = T.predictions(spark, d)
    missed = M.missed_truth(T.truth(spark, d), matches(spark, d), 0.25)
    return E.explain_misses(missed, p, 0.25)


@query(
    "miss_reasons",
    _MISS_SQL + "SELECT category_id, reason, count(*) AS n FROM why GROUP BY 1, 2",
)
def miss_reasons(spark, d):
    return E.miss_reasons(_explained(spark, d))


@query(
    "missed_confusions",
    _MISS_SQL + "SELECT category_id, other_class AS predicted_category_id, count(*) AS n FROM why"
    " WHERE reason = 'class_confusion' GROUP BY 1, 2",
)
def missed_confusions(spark, d):
    return E.missed_confusions(_explained(spark, d))


@query(
    "miss_cases",
    f"WITH {MATCH_SQL}, missed AS (SELECT * FROM truth t WHERE NOT EXISTS (SELECT 1 FROM matches m"
    " WHERE m.image_id = t.image_id AND m.score >= 0.25 AND m.annotation_index = t.annotation_index)),"
    """ sc AS (SELECT m.image_id, m.annotation_index, m.category_id, p.category_id AS p_class, p.score,
    p.prediction_index, coalesce(q.iou, 0) AS iou FROM missed m JOIN preds p USING (image_id)
    LEFT JOIN iou_pairs q ON q.image_id = m.image_id AND q.annotation_index = m.annotation_index
     AND q.prediction_index = p.prediction_index),
    b AS (SELECT image_id, annotation_index,
     arg_max({'s': score, 'i': iou}, (iou, score, -prediction_index))
       FILTER (score >= 0.25 AND p_class = category_id) AS same,
     arg_max({'c': p_class, 'i': iou}, (iou, score, -prediction_index))
       FILTER (score >= 0.25 AND p_class <> category_id) AS other FROM sc GROUP BY 1, 2)
    SELECT m.image_id, m.category_id, m.x, m.y, round(coalesce(same.i, 0), 9) AS same_iou,
     round(coalesce(other.i, 0), 9) AS other_iou, coalesce(other.c, 0) AS other_category_id,
     (same.s IS NOT NULL) AS has_same
    FROM missed m LEFT JOIN b USING (image_id, annotation_index)""",
)
def miss_cases(spark, d):
    return _explained(spark, d).select(
        "image_id",
        "category_id",
        "x",
        "y",
        rounded("same_iou"),
        rounded("other_iou"),
        F.coalesce("other_category_id", F.lit(0)).cast("bigint").alias("other_category_id"),
        F.col("same_prediction_index").isNotNull().alias("has_same"),
    )


@query(
    "size_bin_recall",
    f"WITH {MATCH_SQL} SELECT t.category_id, CASE WHEN least(w, h) < 4 THEN '<4px'"
    " WHEN least(w, h) < 8 THEN '4-8px' WHEN least(w, h) < 16 THEN '8-16px' ELSE '>=16px' END"
    " AS size_bin, count(*) AS targets, count(m.annotation_index) AS matched"
    " FROM (SELECT image_id, annotation_index, category_id, w / 6 AS w, h / 6 AS h FROM truth) t"
    " LEFT JOIN (SELECT image_id, annotation_index FROM matches WHERE annotation_index IS NOT NULL"
    "  AND score >= 0.25) m USING (image_id, annotation_index) GROUP BY 1, 2",
)
def size_bin_recall(spark, d):
    small = T.truth(spark, d).withColumns({"w": F.col("w") / 6, "h": F.col("h") / 6})
    return E.size_recall(small, matches(spark, d), 0.25)


@query(
    "operating_points",
    f"WITH {MATCH_SQL}, {_PROFILE.format(thresholds=POINT_SQL)}"
    " SELECT score_threshold, level, coalesce(category_id, -1) AS category_id, tp, fp, fn,"
    " round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall"
    " FROM prof WHERE level <> 'board'",
)
def operating_points(spark, d):
    return Q.operating_points(T.truth(spark, d), matches(spark, d)).select(
        "score_threshold",
        "level",
        F.coalesce("category_id", F.lit(-1)).cast("bigint").alias("category_id"),
        long("tp"),
        long("fp"),
        long("fn"),
        rounded("precision"),
        rounded("recall"),
    )


# Qualification: finished orders of low priority stand for boards without defects, and wrong
# classes get lower scores, so that precision rises with the threshold.
_EMPTY_SQL = "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F')"


def _qualified(sql: str) -> str:
    score = "CAST((l_partkey*7 + l_suppkey*13) % 101 AS DOUBLE) / 100 AS score"
    told = (
        "CASE WHEN l_suppkey % 10 = 0 THEN CAST((l_partkey*7 + l_suppkey*13) % 101 AS DOUBLE) / 250 + 0.1::DOUBLE"
        " ELSE CAST((l_partkey*7 + l_suppkey*13) % 101 AS DOUBLE) / 125 + 0.2::DOUBLE END AS score"
    )
    whole = "AS h FROM box_base),\npreds"
    assert score in sql and whole in sql
    return sql.replace(score, told).replace(
        whole, f"AS h FROM box_base WHERE image_id NOT IN {_EMPTY_SQL}),\npreds"
    )


_BOARDS_SQL = """boards AS (SELECT i.image_id, i.group_id, coalesce(l.n, 0) AS labels, p.top_score
   FROM imgs i LEFT JOIN (SELECT image_id, count(*) AS n FROM truth GROUP BY 1) l
   USING (image_id) LEFT JOIN (SELECT image_id, max(score) AS top_score FROM preds GROUP BY 1) p
   USING (image_id))"""


def _qualification(spark, d):
    """(truth, predictions, boards) in which some whole boards have no labels."""
    empty = (
        T.read(spark, d, "orders")
        .filter("o_orderpriority = '5-LOW' AND o_orderstatus = 'F'")
        .select(F.col("o_orderkey").alias("image_id"))
    )
    truth = T.truth(spark, d).join(empty, "image_id", "left_anti")
    predictions = T.predictions(spark, d, told=True)
    return truth, predictions, Q.boards(T.images(spark, d), truth, predictions)


@query(
    "board_routing",
    f"WITH {_qualified(BASE_SQL)}, {_BOARDS_SQL}, x AS (SELECT *, labels > 0 AS pos,"
    " coalesce(top_score >= score_threshold, FALSE) AS flag FROM boards,"
    f" {POINT_SQL}), r AS (SELECT score_threshold, group_id, count(*) AS boards,"
    " count_if(pos)::BIGINT AS positive_boards, count_if(NOT pos)::BIGINT AS empty_boards,"
    " count_if(flag)::BIGINT AS flagged_boards, count_if(pos AND NOT flag)::BIGINT AS escaped_boards,"
    " count_if(NOT pos AND flag)::BIGINT AS empty_boards_flagged FROM x"
    " GROUP BY GROUPING SETS ((score_threshold), (score_threshold, group_id)))"
    " SELECT score_threshold, coalesce(group_id, 'all') AS group_id, boards, positive_boards,"
    " empty_boards, flagged_boards, escaped_boards, empty_boards_flagged,"
    " round(flagged_boards / nullif(boards, 0), 9) AS flagged_fraction,"
    " round(escaped_boards / nullif(positive_boards, 0), 9) AS escape_rate,"
    " round(empty_boards_flagged / nullif(empty_boards, 0), 9) AS empty_flag_rate FROM r",
)
def board_routing(spark, d):
    r = Q.board_routing(_qualification(spark, d)[2])
    rates = ["flagged_fraction", "escape_rate", "empty_flag_rate"]
    return r.withColumn("group_id", F.coalesce("group_id", F.lit("all"))).withColumns(
        {c: F.round(c, 9) for c in rates}
    )


_FRONTIER_SQL = f"""WITH {_qualified(MATCH_SQL)}, {_BOARDS_SQL},
th AS (SELECT DISTINCT score AS t FROM preds UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE),
pt AS (SELECT t AS score_threshold,
   (SELECT count(*) FROM matches m WHERE m.score >= t AND outcome = 'matched') AS tp,
   (SELECT count(*) FROM matches m WHERE m.score >= t AND outcome <> 'matched') AS fp,
   (SELECT count(*) FROM boards b WHERE b.top_score >= t) AS flagged_boards,
   (SELECT count(*) FROM boards b WHERE labels > 0) -
   (SELECT count(*) FROM boards b WHERE labels > 0 AND b.top_score >= t)
     AS positive_boards_without_flag FROM th),
fr AS (SELECT *, (SELECT count(*) FROM truth) - tp AS fn FROM pt),
fp AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM fr)
"""


def _frontier(spark, d):
    truth, predictions, boards = _qualification(spark, d)
    return Q.frontier(truth, M.match_detections(truth, predictions), boards)


@query(
    "threshold_frontier",
    _FRONTIER_SQL + "SELECT score_threshold, tp, fp, fn, flagged_boards, positive_boards_without_flag,"
    " round(precision, 9) AS precision, round(recall, 9) AS recall FROM fp",
)
def threshold_frontier(spark, d):
    return _frontier(spark, d).withColumns(
        {"precision": F.round("precision", 9), "recall": F.round("recall", 9)}
    )


@query(
    "best_at_precision",
    _FRONTIER_SQL + "SELECT f AS precision_floor,"
    " arg_max(score_threshold, (coalesce(recall, 0), -fp, score_threshold)) AS score_threshold,"
    " arg_max(tp, (coalesce(recall, 0), -fp, score_threshold)) AS tp FROM fp JOIN"
    " (SELECT unnest([0.5, 0.85, 0.9, 0.92]::DOUBLE[]) AS f) ON precision >= f GROUP BY 1",
)
def best_at_precision(spark, d):
    best = Q.best_at_precision(_frontier(spark, d), (0.5, 0.85, 0.9, 0.92))
    return best.select("precision_floor", "score_threshold", "tp")


@query(
    "highest_zero_escape",
    _FRONTIER_SQL + "SELECT max(score_threshold) AS score_threshold FROM fp"
    " WHERE positive_boards_without_flag = 0 AND tp + fn > 0",
)
def highest_zero_escape(spark, d):
    return Q.highest_zero_escape(_frontier(spark, d))


@query(
    "candidate_thresholds",
    f"WITH {BASE_SQL} SELECT DISTINCT score AS score_threshold FROM preds"
    " UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE",
)
def candidate_thresholds(spark, d):
    return Q.candidate_thresholds(T.predictions(spark, d))


_IOUS = str(A.IOU_THRESHOLDS)
_AP_SQL = f"""WITH {BASE_SQL},
th AS (SELECT unnest(range(10)) AS k, unnest({_IOUS}::DOUBLE[]) AS floor),
top AS (SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY image_id, category_id
   ORDER BY score DESC, prediction_index) <= 100),
cand AS (SELECT k, image_id, p_class AS category_id, prediction_index, score,
   list({{'ai': annotation_index, 'iou': iou}} ORDER BY iou DESC, annotation_index DESC) AS c
   FROM iou_pairs JOIN th ON iou >= floor WHERE p_class = t_class GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, image_id, category_id
   ORDER BY score DESC, prediction_index) AS rk FROM cand),
walk AS (WITH RECURSIVE step(k, image_id, category_id, rk, prediction_index, used, pick) AS (
  SELECT k, image_id, category_id, rk, prediction_index, [c[1].ai], c[1].ai FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.k, r.image_id, r.category_id, r.rk, r.prediction_index,
    CASE WHEN len(list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))) > 0
      THEN list_append(s.used, list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))[1].ai)
      ELSE s.used END,
    CASE WHEN len(list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))) > 0
      THEN list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))[1].ai ELSE NULL END
  FROM step s JOIN ranked r ON r.k = s.k AND r.image_id = s.image_id
    AND r.category_id = s.category_id AND r.rk = s.rk + 1)
 SELECT k, image_id, prediction_index FROM step WHERE pick IS NOT NULL),
det AS (SELECT k, t.image_id, category_id, score, prediction_index, group_id,
   CASE WHEN w.k IS NULL THEN 0 ELSE 1 END AS hit FROM top t JOIN th ON TRUE
   LEFT JOIN walk w USING (k, image_id, prediction_index) <join>),
npos AS (SELECT <by> category_id, count(*) AS npos, count(DISTINCT image_id) AS positive_images
   FROM (SELECT t.*, group_id FROM truth t <join>) GROUP BY ALL),
cum AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS rk FROM det
   WINDOW w AS (PARTITION BY <by> k, category_id ORDER BY score DESC, image_id, prediction_index)),
curve AS (SELECT <by> k, category_id, npos, tp / npos AS rc,
   max(tp / (rk + 2.220446049250313e-16)) OVER (PARTITION BY <by> k, category_id
     ORDER BY rk DESC ROWS UNBOUNDED PRECEDING) AS prec FROM cum JOIN npos USING (<by> category_id)),
pts AS (SELECT <by> n.category_id, th.k, r * 0.01::DOUBLE AS r FROM npos n, th,
   (SELECT unnest(range(101)) AS r)),
q AS (SELECT p.category_id, <byp> p.k, p.r, coalesce(max(c.prec), 0) AS prec FROM pts p
   LEFT JOIN curve c ON <onby> c.category_id = p.category_id AND c.k = p.k AND c.rc >= p.r GROUP BY ALL),
ap AS (SELECT <by> category_id, avg(prec) AS ap50_95, avg(prec) FILTER (k = 0) AS ap50 FROM q GROUP BY ALL),
rec AS (SELECT <by> category_id, sum(hit) / (npos * 10) AS ar100 FROM det
   JOIN npos USING (<by> category_id) GROUP BY <by> category_id, npos),
cls AS (SELECT <by> category_id, ap50_95, ap50, coalesce(ar100, 0) AS ar100, npos AS instances,
   positive_images FROM npos JOIN ap USING (<by> category_id) LEFT JOIN rec USING (<by> category_id))
SELECT <by> coalesce(category_id, -1) AS category_id, round(avg(ap50_95), 7) AS ap50_95,
   round(avg(ap50), 7) AS ap50, round(avg(ar100), 7) AS ar100, sum(instances)::BIGINT AS instances
FROM cls GROUP BY GROUPING SETS ((<by> category_id), (<total>))
"""


def _ap_sql(**parts):
    text = _AP_SQL.replace("<join>", "JOIN imgs USING (image_id)")
    for name, value in parts.items():
        text = text.replace(f"<{name}>", value)
    return text


def _ap_columns(df, *by):
    return df.select(
        *by,
        F.coalesce("category_id", F.lit(-1)).cast("bigint").alias("category_id"),
        rounded("ap50_95", 7),
        rounded("ap50", 7),
        rounded("ar100", 7),
        long("instances"),
    )


@query(
    "average_precision",
    _ap_sql(by="", byp="", onby="", total=""),
)
def average_precision(spark, d):
    return _ap_columns(A.average_precision(T.truth(spark, d), T.predictions(spark, d)))


@query(
    "average_precision_by_group",
    _ap_sql(
        by="group_id,", byp="p.group_id,", onby="c.group_id = p.group_id AND", total="group_id"
    ),
)
def average_precision_by_group(spark, d):
    ap = A.average_precision(
        T.truth(spark, d), T.predictions(spark, d), ["group_id"], T.images(spark, d)
    )
    return _ap_columns(ap, "group_id")


@query(
    "top_detections",
    f"WITH {BASE_SQL} SELECT image_id, category_id, score, x, y FROM preds"
    " QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, prediction_index) <= 3",
)
def top_detections(spark, d):
    top = A.top_detections(T.predictions(spark, d), ["image_id"], 3)
    return top.select("image_id", "category_id", "score", "x", "y")


@query(
    "rejected_predictions",
    f"WITH {BASE_SQL} SELECT image_id, count(*) AS n FROM preds p WHERE NOT EXISTS"
    " (SELECT 1 FROM imgs i WHERE i.image_id = p.image_id AND split = 'validation') GROUP BY 1",
)
def rejected_predictions(spark, d):
    evaluated = T.images(spark, d).filter("split = 'validation'")
    outside = M.rejected_predictions(T.predictions(spark, d), evaluated)
    return outside.groupBy("image_id").agg(F.count("*").alias("n"))


@query(
    "invalid_predictions",
    f"WITH {BASE_SQL}, s AS (SELECT image_id, category_id, score * 1.02 AS score, x + 8 AS x, y, w, h"
    " FROM preds JOIN imgs USING (image_id)), r AS (SELECT image_id,"
    " CASE WHEN score < 0 OR score > 1 THEN 'invalid_score' WHEN category_id > 4 THEN 'invalid_class'"
    " WHEN x < 0 OR y < 0 OR w <= 0 OR h <= 0 OR x + w > 640 + 1e-6 OR y + h > 480 + 1e-6"
    " THEN 'invalid_box' END AS reason FROM s)"
    " SELECT reason, count(*) AS n, count(DISTINCT image_id) AS images FROM r"
    " WHERE reason IS NOT NULL GROUP BY 1",
)
def invalid_predictions(spark, d):
    shifted = T.predictions(spark, d).withColumns(
        {"score": F.col("score") * 1.02, "x": F.col("x") + 8}
    )
    bad = M.invalid_predictions(shifted, T.images(spark, d), 4)
    return bad.groupBy("reason").agg(
        F.count("*").alias("n"), F.count_distinct("image_id").alias("images")
    )


@query(
    "zero_escape_sample_size",
    f"WITH {BASE_SQL}, r AS (SELECT group_id, (1 + count_if(split = 'test')) / (3 + 2 * count(*)) AS rate"
    " FROM imgs GROUP BY 1) SELECT group_id, round(rate, 9) AS max_rate,"
    " CAST(ceil(ln(1 - 0.95) / ln(1 - rate)) AS BIGINT) AS boards FROM r",
)
def zero_escape_sample_size(spark, d):
    rates = T.images(spark, d).groupBy("group_id").agg(
        ((1 + F.count_if(F.col("split") == "test")) / (3 + 2 * F.count("*"))).alias("rate")
    )
    return rates.select(
        "group_id",
        F.round("rate", 9).alias("max_rate"),
        G.zero_escape_sample_size("rate").alias("boards"),
    )
