"""Queries of operators whose inputs or outputs are files.

The supplied tables are written to the shared folder in the form of the source (JSON
documents, label files, pixels) and read back by the operator, whole.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from detlake.functions import pixels as X
from detlake.functions.sql import register_sql
from detlake.functions.text import json_equal
from detlake.operators import derive as Y
from detlake.operators import grouping as R
from detlake.operators import near as N
from detlake.operators import scoring as P
from detlake.operators import validate as V
from detlake.operators.running import running_totals
from detlake.plans import tables as T
from detlake.plans.curation import _EDGE_SQL, _NEAR_SQL, _edges, _pixels
from detlake.plans.operations import _DET_SQL, _detections
from detlake.plans.registry import query
from detlake.plans.tables import BASE_SQL, FILES_SQL
from detlake.session import scratch_path
from detlake.sinks import tables as K
from detlake.sources import documents as S
from detlake.sources import files as W


#: Entries of one JSON document, about, and bytes of one review batch: a document is read by one
#: task, so a larger table is written as more documents and not as longer ones.
ENTRIES = 10_000
BATCH_BYTES = 2_000_000


def _documents(df, keys, label):
    """Rows (keys, body) as one JSON file each, in folders named by the keys."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*keys).option("maxRecordsPerFile", 1).text(path)
    return path


def _part(rows, *by):
    """The document of each row: as many documents as hold ``ENTRIES`` of ``rows`` each."""
    return F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(rows.count() / ENTRIES))).cast("bigint"))


# Sources


@query(
    "coco_source",
    f"WITH {BASE_SQL} SELECT split, annotation_index AS annotation_id, image_id, category_id, x, y, w, h FROM truth JOIN imgs USING (image_id)",
)
def coco_source(spark, d):
    """Exports of whole images, several a split."""
    truth = T.truth(spark, d)
    images = T.images(spark, d).withColumn("part", _part(truth, "image_id"))
    boxes = truth.join(images.select("image_id", "split", "part"), "image_id").groupBy("split", "part").agg(
        F.collect_list(
            F.struct(F.col("annotation_index").alias("id"), "image_id", "category_id", F.array(*"xywh").alias("bbox"))
        ).alias("annotations")
    )
    named = F.struct(F.col("image_id").alias("id"), F.format_string("%d.png", "image_id").alias("file_name"), "width", "height")
    exports = images.groupBy("split", "part").agg(F.collect_list(named).alias("images")).join(boxes, ["split", "part"])
    body = F.to_json(F.struct("images", "annotations", F.array().cast("array<struct<id: bigint, name: string>>").alias("categories")))
    path = _documents(exports.select("split", body.alias("body")), ["split"], "coco")
    rows = None
    for split in T.SPLITS:
        part = S.read_coco(spark, f"{path}/split={split}", split).annotations
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("split", "annotation_id", "image_id", "category_id", *"xywh")


@query(
    "yolo_source",
    """SELECT 'board=' || (l_suppkey % 25) AS board, row_number() OVER (PARTITION BY l_suppkey % 25 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS line_number,
  CASE WHEN l_linenumber <> 7 THEN (l_partkey % 5)::DOUBLE END AS category, CASE WHEN l_linenumber <> 7 THEN (l_partkey % 128) / 128 END AS cx,
  CASE WHEN l_linenumber = 7 THEN 'invalid_yolo_line' END AS issue FROM lineitem""",
)
def yolo_source(spark, d):
    """One label file a board; the seventh line of an order lacks its numbers."""
    line = F.when(F.col("l_linenumber") == 7, F.lit("0 0.5")).otherwise(
        F.concat_ws(" ", F.col("l_partkey") % 5, (F.col("l_partkey") % 128) / 128, F.lit("0.5 0.25 0.25"))
    )
    rows = T.read(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("board"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", line.alias("value")
    )
    path = scratch_path(spark, "yolo")
    ordered = rows.repartition("board").sortWithinPartitions("board", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ordered.select("board", "value").write.partitionBy("board").text(path)
    parsed = W.parse_yolo_lines(W.read_yolo(spark, path))
    good = F.col("issue").isNull()
    return parsed.select(
        F.element_at(F.split("label_path", "/"), -2).alias("board"), F.col("line_number").cast("bigint").alias("line_number"),
        F.when(good, F.col("category")).alias("category"), F.when(good, F.col("cx")).alias("cx"), "issue",
    )


@query(
    "manifest_source",
    f"""WITH {FILES_SQL} SELECT path, sha256, width::BIGINT AS width, group_id, split, coalesce(quality, -1)::BIGINT AS class_id FROM docs
  LEFT JOIN labels ON doc_id = image_id""",
)
def manifest_source(spark, d):
    """Manifests of one language each; labelled documents have one annotation."""
    box = F.struct(*[F.lit(float(i)).alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])])
    labels = T.read(spark, d, "labels").select(F.col("doc_id").alias("image_id"), F.struct(F.col("quality").alias("class_id"), box.alias("bbox")).alias("a"))
    files = T.document_files(spark, d)
    rows = files.withColumn("part", _part(files, "image_id")).join(labels, "image_id", "left")
    sample = F.struct(
        F.col("path").alias("image"), "sha256", "width", "height", "group_id", "split",
        F.array_compact(F.array("a")).alias("annotations"),
    )
    body = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.array(F.lit("q0"), F.lit("q1")).alias("classes"), "samples"))
    named = rows.groupBy("lang", "part").agg(F.collect_list(sample).alias("samples")).select("lang", body.alias("body"))
    path = _documents(named, ["lang"], "manifests")
    found = S.read_manifest(spark, path)
    # Paths repeat within and between manifests: rows are met by their manifest and their place in it.
    boxes = found.annotations.select("document", F.col("image_ordinal").alias("ordinal"), "class_id")
    keyed = found.images.join(boxes, ["document", "ordinal"], "left")
    return keyed.select(
        "path", "sha256", F.col("width").cast("bigint").alias("width"), "group_id", "split",
        F.coalesce("class_id", F.lit(-1)).cast("bigint").alias("class_id"),
    )


@query(
    "saved_predictions_source",
    f"WITH {BASE_SQL} SELECT 'run=' || (category_id % 3) AS run_id, image_id, category_id, x, y, w, h, score FROM preds",
)
def saved_predictions_source(spark, d):
    """Three runs, each saved in several documents."""
    rows = T.predictions(spark, d)
    rows = rows.withColumns({"run": F.col("category_id") % 3, "part": _part(rows, "image_id", "prediction_index")})
    one = F.struct("image_id", "category_id", F.array(*"xywh").alias("bbox"), "score")
    saved = rows.groupBy("run", "part").agg(F.collect_list(one).alias("predictions"))
    body = F.to_json(F.struct(F.array(F.lit("a.png")).alias("source_images"), "predictions"))
    path = _documents(saved.select("run", body.alias("body")), ["run"], "predictions")
    predictions = S.read_saved_predictions(spark, path)[1]
    return predictions.select("run_id", "image_id", "category_id", *"xywh", "score")


@query(
    "review_batch_source",
    """SELECT 'c' || conv_id || '-' || turn AS case_id, role AS reviewer, CASE WHEN length(text) % 2 = 0 THEN 'related' ELSE 'unrelated' END AS answer,
  text AS rationale FROM conversations""",
)
def review_batch_source(spark, d):
    """Turns as decisions, in batches of one role and of a size that the reader takes."""
    answer = F.when(F.length("text") % 2 == 0, "related").otherwise("unrelated")
    one = F.struct(
        F.concat_ws("-", F.concat(F.lit("c"), "conv_id"), "turn").alias("case_id"),
        F.create_map(F.lit("relationship"), answer).alias("answers"), F.col("text").alias("rationale"),
    )
    turns = T.read(spark, d, "conversations").select("role", one.alias("d"), F.octet_length(F.to_json(one)).cast("bigint").alias("size"))
    order = [F.col(c) for c in ("role", "d.case_id", "d.rationale")]
    placed = running_totals(turns, [], order, {"upto": F.col("size")})
    part = F.expr(f"(upto - size) div {BATCH_BYTES}").alias("part")
    batches = placed.groupBy("role", part).agg(F.collect_list("d").alias("decisions"))
    body = F.to_json(
        F.struct(F.lit("1.0").alias("schema_version"), F.lit("p").alias("packet_sha256"), F.col("role").alias("reviewer"),
                 F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"), "decisions")
    )
    path = _documents(batches.select("role", body.alias("body")), ["role"], "reviews")
    rows = S.read_review_batches(spark, path)
    return rows.select("case_id", "reviewer", F.col("answers")["relationship"].alias("answer"), "rationale")


# Sinks


@query(
    "release_tables",
    f"""WITH {BASE_SQL} SELECT 'images' AS "table", count(*) AS rows FROM imgs UNION ALL SELECT 'annotations', count(*) FROM truth UNION ALL
  SELECT 'lineage', count(*) FROM imgs UNION ALL SELECT 'group_counts', count(*) FROM (SELECT DISTINCT group_id, category_id FROM truth JOIN imgs USING (image_id))""",
)
def release_tables(spark, d):
    """Written twice: the second writing finds the same rows and changes nothing."""
    root = scratch_path(spark, "release")
    images, boxes = T.images(spark, d), T.truth(spark, d)
    for _ in range(2):
        release = K.write_release(root, images, boxes, images.select("image_id"), "1.0")
    return release.select("table", "rows")


@query(
    "audit_inventory",
    f"WITH {FILES_SQL} SELECT image_id, sha256, (SELECT count(*) FROM docs) AS images FROM docs",
)
def audit_inventory(spark, d):
    root = scratch_path(spark, "audit")
    inventory = T.document_files(spark, d).select("image_id", "sha256")
    summary = K.write_audit(root, inventory, inventory.limit(0)).select("images")
    written = spark.read.schema(inventory.schema).json(f"{root}/inventory")
    return written.join(F.broadcast(summary)).select("image_id", "sha256", "images")


@query(
    "research_set",
    f"""WITH {FILES_SQL} SELECT 'images' AS "table", count(*) AS rows FROM docs WHERE split = 'train' UNION ALL SELECT 'corrections', count(*) FROM labels
  UNION ALL SELECT 'quarantine', count(*) FROM docs WHERE split <> 'train'""",
)
def research_set(spark, d):
    files = T.document_files(spark, d)
    train = F.col("split") == "train"
    return K.write_research_set(
        scratch_path(spark, "research"), files.filter(train), T.read(spark, d, "labels"), files.filter(~train)
    )


# Pixels

_WIDE, _HIGH = 72, 8
_PIXEL = "(doc_id * 31 + coalesce(n_chars, 0) * 7 + i * i * (doc_id % 11 + 1) + i * 13) % 256"
_BIT_SQL = "list_sum([CASE WHEN {test} THEN 1::HUGEINT << {place} ELSE 0 END FOR k IN range(64)])"
_SIGNED_SQL = "CAST(CASE WHEN {v} >= 9223372036854775808 THEN {v} - 18446744073709551616 ELSE {v} END AS BIGINT)"


@query(
    "image_fingerprints",
    f"""WITH px AS (SELECT doc_id, [({_PIXEL})::BIGINT FOR i IN range({_WIDE * _HIGH})] AS p FROM documents),
 gr AS (SELECT doc_id, p, [round_even(list_sum([p[(k // 9) * 72 + (k % 9) * 8 + j + 1] FOR j IN range(8)]) / 8, 0) FOR k IN range(72)] AS g9,
  [round_even(list_sum([p[(k // 8) * 72 + (k % 8) * 9 + j + 1] FOR j IN range(9)]) / 9, 0) FOR k IN range(64)] AS g8 FROM px),
 me AS (SELECT *, list_sum(g8) / 64 AS m FROM gr),
 bi AS (SELECT *, {_BIT_SQL.format(test="g9[(k // 8) * 9 + k % 8 + 1] > g9[(k // 8) * 9 + k % 8 + 2]", place="(63 - k)")} AS d,
  {_BIT_SQL.format(test="g8[k + 1] >= m", place="k")} AS a, {_BIT_SQL.format(test="g8[(k // 8) * 8 + 8 - k % 8] >= m", place="k")} AS r FROM me)
 SELECT doc_id, {_SIGNED_SQL.format(v="d")} AS dhash, {_SIGNED_SQL.format(v="a")} AS ahash, {_SIGNED_SQL.format(v="r")} AS ahash_mirrored,
  sha256('{_WIDE}x{_HIGH}:'::BLOB || unhex(array_to_string([repeat(printf('%02x', v), 3) FOR v IN p], ''))) AS pixel_sha256 FROM bi""",
)
def image_fingerprints(spark, d):
    """Grey pictures of 72 by 8 pixels made from the documents' numbers."""
    pixel = f"transform(sequence(0, {_WIDE * _HIGH - 1}), i -> {_PIXEL})"
    hexed = f"array_join(transform({pixel}, v -> lpad(hex(v), 2, '0')), '')"
    decoded = T.read(spark, d, "documents").select(
        F.col("doc_id").alias("path"), F.lit(_WIDE).alias("width"), F.lit(_HIGH).alias("height"), F.lit(1).alias("channels"),
        F.expr(f"unhex({hexed})").alias("pixels"),
    )
    return X.fingerprints(decoded).select(
        F.col("path").alias("doc_id"), "dhash", F.get("ahash", F.lit(0)).alias("ahash"),
        F.get("ahash", F.lit(4)).alias("ahash_mirrored"), "pixel_sha256",
    )


# Reports


@query(
    "inspection_reports",
    _DET_SQL.replace("AS confidence FROM", "AS confidence, CAST((l_partkey*37) % 560 AS DOUBLE) AS x1, CAST((l_partkey*53) % 400 AS DOUBLE) AS y1 FROM")
    + """, sized AS (SELECT o_orderkey AS image_id, 575 - o_orderkey % 9 AS width, 480 AS height, o_orderkey % 50 AS ms FROM orders),
 met AS (SELECT *, x1 + 16 > width AS bad FROM sized LEFT JOIN det USING (image_id)),
 per AS (SELECT image_id, any_value(width) AS width, any_value(ms) AS ms, coalesce(count_if(bad), 0) AS issues, coalesce(count_if(confidence >= 0.7), 0) AS findings,
  coalesce(count_if(confidence < 0.7), 0) AS ignored FROM met GROUP BY 1),
 fi AS (SELECT image_id, defect_type, confidence, x1, y1, CASE WHEN defect_type IN ('solder_bridge', 'missing_component') THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN confidence >= 0.9 THEN 'high' ELSE 'review' END AS band FROM det WHERE confidence >= 0.7)
 SELECT p.image_id, CASE WHEN issues > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN issues > 0 THEN 'INFERENCE_FAILED' END AS error_code,
  issues::BIGINT AS issues, CASE WHEN issues = 0 THEN width ELSE -1 END::BIGINT AS image_width, CASE WHEN issues = 0 THEN ms ELSE -1 END::BIGINT AS inference_time_ms,
  CASE WHEN issues = 0 THEN ignored ELSE -1 END::BIGINT AS ignored, CASE WHEN issues = 0 THEN CASE WHEN findings > 0 THEN 'REVIEW_REQUIRED' ELSE 'NO_VISIBLE_DEFECTS_DETECTED'
  END END AS overall_result, CASE WHEN issues = 0 THEN 2 ELSE 0 END::BIGINT AS limitations, defect_type, confidence, x1, y1, severity, band
 FROM per p LEFT JOIN fi f ON f.image_id = p.image_id AND p.issues = 0""",
)
def inspection_reports(spark, d):
    """Every report with every finding, one row each; images are too narrow for some boxes."""
    inspections = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), (F.lit(575) - F.col("o_orderkey") % 9).cast("int").alias("width"),
        F.lit(480).alias("height"), (F.col("o_orderkey") % 50).alias("inference_time_ms"),
    )
    reports = P.inspection_reports(inspections, _detections(spark, d), "model-1")
    flat = reports.select("*", F.explode_outer("detections").alias("f"))
    none = F.lit(-1)
    return flat.select(
        "image_id", "status", "error_code", "issues", "overall_result",
        F.coalesce("image_width", none).cast("bigint").alias("image_width"),
        F.coalesce("inference_time_ms", none).cast("bigint").alias("inference_time_ms"),
        F.coalesce("ignored_detection_count", none).alias("ignored"),
        F.size(F.coalesce("limitations", F.array().cast("array<string>"))).cast("bigint").alias("limitations"),
        F.col("f.defect_type").alias("defect_type"), F.col("f.confidence").alias("confidence"), F.col("f.x1").alias("x1"), F.col("f.y1").alias("y1"),
        F.col("f.severity").alias("severity"), F.col("f.confidence_band").alias("band"),
    )


@query(
    "json_equality",
    "SELECT event_id, event_id % 4 IN (0, 1) AS equal FROM events",
)
def json_equality(spark, d):
    """The props of each event beside another spelling, another type, and another value of them."""
    k = F.get_json_object("props", "$.k")
    left = F.format_string('{"props": %s, "list": [1.0, true, "1"]}', "props")
    right = F.when(F.col("event_id") % 4 == 0, F.format_string('{"list":[1,true,"1"],"props":{"k":%s.00}}', k)).when(
        F.col("event_id") % 4 == 1, F.format_string('{"list": [1e0, true, "1"], "props": {"k": %s}}', k)
    ).when(F.col("event_id") % 4 == 2, F.format_string('{"list":[true,1,"1"],"props":{"k":%s}}', k)).otherwise(
        F.format_string('{"list":[1,true,"1"],"props":{"k":"%s"}}', k)
    )
    return T.events(spark, d).select("event_id", json_equal(left, right).alias("equal"))


# Review packets


_QUEUE_SQL = _NEAR_SQL + """, lk AS (SELECT least(a.s12, b.s12) AS a, greatest(a.s12, b.s12) AS b, any_value(distance) AS distance, count(*) AS pairs
  FROM np JOIN sig a ON a.image_id = first_image_id JOIN sig b ON b.image_id = second_image_id GROUP BY 1, 2)
"""


def _queue(spark, d):
    images = _pixels(spark, d)
    links = N.near_links(images, 1, 12)
    audited = N.cross_split_pair_count(images, links).first()[0]
    return images, R.checked_queue(images, links, audited)


@query("signature_queue", _QUEUE_SQL + "SELECT a, b, distance, pairs FROM lk")
def signature_queue(spark, d):
    return _queue(spark, d)[1].select("a", "b", "distance", "pairs")


@query(
    "queue_page",
    _QUEUE_SQL + """, ru AS (SELECT *, sum(pairs) OVER (ORDER BY a, b) AS upto FROM lk)
 SELECT first_image_id, second_image_id, np.distance, (upto - pairs + 1)::BIGINT AS link_rank FROM np JOIN sig x ON x.image_id = first_image_id
 JOIN sig y ON y.image_id = second_image_id JOIN ru ON ru.a = least(x.s12, y.s12) AND ru.b = greatest(x.s12, y.s12)
 WHERE upto - pairs + 1 <= 300 AND upto >= 101""",
)
def queue_page(spark, d):
    """The links that hold places 101 to 300 of the review queue."""
    images, queue = _queue(spark, d)
    page = N.expand_queue(images, queue, 101, 300)
    return page.select("first_image_id", "second_image_id", "distance", "link_rank")


@query(
    "packet_catalog",
    _NEAR_SQL + """SELECT 'near-' || sha256('["' || least(first_image_id, second_image_id) || '","' || greatest(first_image_id, second_image_id) || '"]') AS case_id,
  'near' AS kind FROM np UNION ALL SELECT 'box-' || sha256('["' || vec_id || '","0"]'), 'box' FROM embeddings WHERE vec_id % 3 = 0
 UNION ALL SELECT DISTINCT 'class-' || sha256('["release","' || label || '"]'), 'class' FROM embeddings
 UNION ALL SELECT 'source-' || sha256('["release","' || t || '"]'), 'source' FROM (SELECT unnest(['rights_and_provenance', 'source_grouping_and_split_review']) AS t)""",
)
def packet_catalog(spark, d):
    """All cases of a packet: near pairs, boxes over the right edge, class definitions, the source itself."""
    images = _pixels(spark, d).withColumns({"width": F.lit(640), "height": F.lit(480)})
    over = F.when(F.col("image_id") % 3 == 0, 40.01).otherwise(20.0)
    boxes = images.select(
        "image_id", F.lit(0).alias("annotation_index"), F.lit(1).alias("category_id"), F.lit(600.0).alias("x"),
        F.lit(10.0).alias("y"), over.alias("w"), F.lit(20.0).alias("h"),
    )
    categories = T.read(spark, d, "embeddings").select(F.lit("release").alias("source"), F.col("label").alias("category_id"), F.lit("c").alias("name"))
    packet = Y.build_packet(images, boxes, k=1, width=12, categories=categories)
    root = scratch_path(spark, "packet")
    K.write_packet(root, packet)
    return spark.read.parquet(f"{root}/cases").select("case_id", "kind")


@query(
    "related_groups",
    _EDGE_SQL.replace("<= 4),", "<= 4 UNION ALL SELECT image_id, image_id + 7 FROM sig WHERE image_id % 50 = 0 AND image_id + 7 IN (SELECT image_id FROM sig)"
                      " UNION ALL SELECT image_id + 7, image_id FROM sig WHERE image_id % 50 = 0 AND image_id + 7 IN (SELECT image_id FROM sig)),")
    + "SELECT node AS image_id, component AS group_id FROM comp",
)
def related_groups(spark, d):
    """Groups after the pairs that a reviewer called related have been added."""
    images, edges = _edges(spark, d)
    pair = images.select(F.col("image_id").alias("src"), (F.col("image_id") + 7).alias("dst"))
    known = pair.join(images.select(F.col("image_id").alias("dst")), "dst", "left_semi")
    said = F.when(F.col("src") % 50 == 0, "related").otherwise("unrelated")
    reviewed = known.withColumn("relationship", said)
    return R.assign_groups(images, R.with_reviewed_links(edges, reviewed)).select("image_id", "group_id")


# Validation


@query(
    "license_findings",
    """WITH l AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN '/' ELSE '' END || 'licenses/' || s_suppkey || '.txt' AS evidence FROM supplier)
 SELECT 'usage_not_permitted' AS code, NULL AS detail, count(*) AS n FROM l WHERE k % 3 = 0 HAVING count(*) > 0 UNION ALL
 SELECT 'invalid_review_date', NULL, count(*) FROM l WHERE k % 11 = 0 HAVING count(*) > 0 UNION ALL
 SELECT 'unsafe_license_path', evidence, 1 FROM l WHERE k % 7 = 0 UNION ALL
 SELECT 'missing_license_evidence', evidence, 1 FROM l WHERE k % 7 <> 0 AND k % 5 = 0""",
)
def license_findings(spark, d):
    k = F.col("s_suppkey")
    evidence = F.concat(F.when(k % 7 == 0, "/").otherwise(""), F.lit("licenses/"), k, F.lit(".txt"))
    suppliers = T.read(spark, d, "supplier")
    header = suppliers.select(
        F.struct(
            evidence.alias("evidence"), F.array(F.when(k % 3 == 0, "display").otherwise("research")).alias("allowed_uses"),
            F.when(k % 11 == 0, "2999-01-01").otherwise("2020-01-01").cast("date").alias("reviewed_on"),
        ).alias("license")
    )
    listing = suppliers.select(evidence.alias("path"), F.when(k % 5 == 0, 0).otherwise(9).alias("length"))
    found = V.license_issues(header, "research", listing)
    return found.groupBy("code", "detail").agg(F.count("*").alias("n"))


@query(
    "missing_labels",
    "SELECT 'x/images/' || o_orderkey || '.png' AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
)
def missing_labels(spark, d):
    """Images of orders without a large line have no label file."""
    images = T.read(spark, d, "orders").select(F.format_string("x/images/%d.png", "o_orderkey").alias("path"))
    images = images.withColumn("label_path", W.label_path_of(F.col("path")))
    held = T.read(spark, d, "lineitem").filter("l_quantity > 40").select(F.format_string("x/labels/%d.txt", "l_orderkey").alias("label_path"))
    return V.missing_label_issues(images, held).select(F.get("images", F.lit(0)).alias("path"))


@query(
    "validation_findings",
    f"""WITH {FILES_SQL}, im AS (SELECT *, 'images/' || image_id || '.png' AS p, (('0x' || left(sha256, 15))::BIGINT) AS sg FROM docs),
 rep AS (SELECT *, min(ordinal) OVER (PARTITION BY actual_sha256) AS fb, min(ordinal) OVER (PARTITION BY pixel_sha256) AS fp FROM im),
 fam AS (
 SELECT 'usage_not_permitted' AS code, 1::BIGINT AS n UNION ALL
 SELECT 'unknown_class', count(*) FROM labels WHERE toxic = 1 AND quality = 1 UNION ALL
 SELECT 'out_of_bounds', count(*) FROM labels WHERE NOT (toxic = 1 AND quality = 1) AND doc_id % 17 = 0 UNION ALL
 SELECT 'duplicate_path', 0 UNION ALL SELECT 'unsafe_path', 0 UNION ALL
 SELECT 'checksum_mismatch', count(*) FROM im WHERE sha256 <> actual_sha256 UNION ALL
 SELECT 'duplicate_bytes', count(*) FROM rep WHERE ordinal > fb UNION ALL
 SELECT 'duplicate_pixels', count(*) FROM rep r JOIN rep f ON f.ordinal = r.fp WHERE r.ordinal > r.fp AND f.sha256 <> r.actual_sha256 UNION ALL
 SELECT 'dimension_mismatch', count(*) FROM im WHERE width <> actual_width UNION ALL
 SELECT 'possible_visual_leakage', count(*) FROM im a JOIN im b ON a.sg = b.sg AND a.ordinal < b.ordinal AND a.split <> b.split UNION ALL
 SELECT 'group_leakage', count(*) FROM (SELECT group_id FROM im GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL
 SELECT 'empty_split', 0 UNION ALL
 SELECT 'missing_class_coverage', count(*) FROM (SELECT unnest(['train', 'validation', 'test']) AS s) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c)
  WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN im ON l.doc_id = im.image_id WHERE split = s AND CASE WHEN toxic = 1 AND quality = 1 THEN 9 ELSE toxic * 2 + quality END = c))
 SELECT code, n FROM fam WHERE n > 0""",
)
def validation_findings(spark, d):
    """All finding families of a data set at once, counted."""
    files = T.document_files(spark, d)
    path = F.format_string("images/%d.png", "image_id")
    images = files.select(
        path.alias("path"), "ordinal", "sha256", "width", "height", "group_id", "split", "actual_sha256", "pixel_sha256", "actual_width",
    )
    strange = (F.col("toxic") == 1) & (F.col("quality") == 1)
    annotations = T.read(spark, d, "labels").select(
        F.format_string("images/%d.png", "doc_id").alias("path"),
        F.when(strange, 9).otherwise(F.col("toxic") * 2 + F.col("quality")).cast("bigint").alias("class_id"),
        F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"),
        F.when(F.col("doc_id") % 17 == 0, 900.0).otherwise(20.0).alias("x2"), F.lit(20.0).alias("y2"),
    )
    classes = spark.range(4).select(F.col("id").alias("class_id"), F.concat(F.lit("q"), "id").alias("name"))
    header = spark.range(1).select(
        F.struct(F.lit("licenses/a.txt").alias("evidence"), F.array(F.lit("display")).alias("allowed_uses"),
                 F.lit("2020-01-01").cast("date").alias("reviewed_on")).alias("license")
    )
    listing = spark.range(1).select(F.lit("licenses/a.txt").alias("path"), F.lit(1).alias("length"))
    signature = F.conv(F.substring("sha256", 1, 15), 16, 10).cast("bigint")
    decoded = images.select("path", F.col("actual_width").alias("width"), "height", "pixel_sha256", F.array(signature).alias("ahash"))
    manifest = SimpleNamespace(
        header=header, classes=classes, annotations=annotations,
        images=images.drop("actual_sha256", "pixel_sha256", "actual_width"),
    )
    found = V.validate_dataset(manifest, images.select("path", "actual_sha256"), decoded, listing)
    return found.groupBy("code").agg(F.sum("n").alias("n"))


@query(
    "sql_tiles",
    """WITH s AS (SELECT p_partkey AS k, 300 + p_size * 41 AS w, 200 + p_size * 29 AS h FROM part),
 st AS (SELECT k, w, h, list_distinct(list_append(range(0, greatest(w - 512, 0) + 1, 448), greatest(w - 512, 0))) AS xs,
  list_distinct(list_append(range(0, greatest(h - 512, 0) + 1, 448), greatest(h - 512, 0))) AS ys FROM s)
 SELECT k, x::INT AS x1, y::INT AS y1, least(w, x + 512)::INT AS x2, least(h, y + 512)::INT AS y2
 FROM (SELECT k, w, h, unnest(xs) AS x, ys FROM st), LATERAL (SELECT unnest(ys) AS y)""",
)
def sql_tiles(spark, d):
    """The table function ``tiles`` called from SQL for every part's picture."""
    register_sql(spark)
    T.read(spark, d, "part").select(
        F.col("p_partkey").alias("k"), (300 + F.col("p_size") * 41).cast("int").alias("w"), (200 + F.col("p_size") * 29).cast("int").alias("h")
    ).createOrReplaceTempView("pictures")
    return spark.sql("SELECT k, t.* FROM pictures, LATERAL tiles(w, h, 512, 64) AS t")
