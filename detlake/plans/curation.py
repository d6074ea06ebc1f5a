"""Audit, near-duplicate, grouping, split and validation queries.

Every query reads its whole tables. Conditions on remainders plant the defects a query has
to find (a missing row, a changed value); they never shorten the work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.functions import hashing as H
from detlake.functions import text as X
from detlake.operators import components as C
from detlake.operators import grouping as R
from detlake.operators import near as N
from detlake.operators import splits as S
from detlake.operators import stats as D
from detlake.operators import tiles as L
from detlake.operators import validate as V
from detlake.plans import tables as T
from detlake.plans.registry import long, query, rounded
from detlake.plans.tables import BASE_SQL, FILES_SQL, SIGNATURE_SQL

CLASS_SQL = "(SELECT unnest([1, 2, 3, 4, 5, 6]) AS category_id)"


def categories(spark):
    return spark.range(1, 7).select(
        F.col("id").alias("category_id"), F.concat(F.lit("class"), "id").alias("name")
    )


def xyxy(df):
    return df.select("image_id", "annotation_index", "category_id", *G.xywh_to_xyxy(*"xywh"))


# Statistics


@query(
    "image_statistics",
    f"WITH {BASE_SQL}, b AS (SELECT image_id, count(*) AS n FROM truth GROUP BY 1),"
    " r AS (SELECT split, '640x480' AS dimension, coalesce(n, 0) AS boxes FROM imgs LEFT JOIN b"
    " USING (image_id)) SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(dimension) = 0"
    " THEN 'dimension' ELSE 'total' END AS level, coalesce(split, dimension, 'all') AS value,"
    " count(*) AS images, sum(boxes)::BIGINT AS annotations, count_if(boxes = 0)::BIGINT AS empty_images"
    " FROM r GROUP BY GROUPING SETS ((split), (dimension), ())",
)
def image_statistics(spark, d):
    return D.image_statistics(T.images(spark, d), T.truth(spark, d))


@query(
    "class_statistics",
    f"WITH {BASE_SQL} SELECT c.category_id::BIGINT AS category_id, count(image_id) AS annotations,"
    f" count(DISTINCT image_id) AS positive_images FROM {CLASS_SQL} c LEFT JOIN truth t"
    " ON t.category_id = c.category_id GROUP BY 1",
)
def class_statistics(spark, d):
    return D.class_statistics(T.truth(spark, d), categories(spark)).drop("name")


@query(
    "archive_summary",
    f"WITH {BASE_SQL}, t AS (SELECT image_id, x + 30 AS x1, y AS y1, x + 30 + w AS x2, y + h AS y2"
    " FROM truth), i AS (SELECT o_orderkey AS image_id, o_totalprice AS lum, 640 * (480 + o_custkey % 100) AS px FROM orders),"
    " v AS (SELECT image_id, count(*) AS n, count_if(x2 <= 640) AS ok,"
    " sum((x2-x1)*(y2-y1)/px) FILTER (x2 <= 640) AS f FROM t JOIN i USING (image_id) GROUP BY 1)"
    " SELECT count(*) AS images, sum(coalesce(n, 0))::BIGINT AS annotations, max(px / 1e6) AS megapixels_max,"
    " min(px / 1e6) AS megapixels_min, round(avg(px / 1e6), 9) AS megapixels_mean,"
    " round(avg(lum), 4) AS mean_luminance, count_if(n IS NULL)::BIGINT AS negative_images,"
    " count_if(px > 350000)::BIGINT AS oversized_images, round(sum(f) / sum(ok), 9) AS mean_box_fraction FROM i LEFT JOIN v USING (image_id)",
)
def archive_summary(spark, d):
    images = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.lit(640).alias("width"),
        (480 + F.col("o_custkey") % 100).alias("height"),
        F.col("o_totalprice").alias("mean_luminance"),
    )
    boxes = xyxy(T.truth(spark, d).withColumn("x", F.col("x") + 30))
    return D.archive_summary(images, boxes, 350_000).withColumns(
        {
            "mean_luminance": F.round("mean_luminance", 4),
            "megapixels_mean": F.round("megapixels_mean", 9),
            "mean_box_fraction": F.round("mean_box_fraction", 9),
        }
    )


@query(
    "family_splits",
    f"WITH {FILES_SQL}, f AS (SELECT regexp_extract(group_id, 'src([0-9]+)', 1) AS family, split FROM docs)"
    " SELECT family, count_if(split = 'train')::BIGINT AS train, count_if(split = 'validation')::BIGINT"
    " AS validation, count_if(split = 'test')::BIGINT AS test, count(DISTINCT split) > 1 AS crosses_splits"
    " FROM f GROUP BY 1",
)
def family_splits(spark, d):
    rows = T.document_files(spark, d).withColumn(
        "family", F.regexp_extract("group_id", "src([0-9]+)", 1)
    )
    return D.family_splits(rows, T.SPLITS)


@query(
    "latency_summary",
    "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 9) AS p50,"
    " round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY 1",
)
def latency_summary(spark, d):
    rows = D.latency_summary(T.read(spark, d, "events"), "value", ["event_type"])
    return rows.select("event_type", rounded("mean", 6), rounded("p50"), rounded("p95"))


@query(
    "distinct_counts",
    f"WITH {BASE_SQL} SELECT count(*) AS rows, count(DISTINCT image_id) AS images,"
    " count(DISTINCT group_id) AS groups FROM imgs",
)
def distinct_counts(spark, d):
    return D.distinct_counts(T.images(spark, d))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, d):
    return D.duplicate_keys(T.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "latency_histogram",
    "WITH l AS (SELECT 'GET' AS method, event_type AS route, value / 100 AS seconds FROM events),"
    " b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5,"
    " 10.0]::DOUBLE[] || ['inf'::DOUBLE]) AS le) SELECT method, route, le, count(*) FILTER (seconds <= le) AS requests,"
    " round(sum(seconds), 6) AS total_seconds FROM l, b GROUP BY 1, 2, 3",
)
def latency_histogram(spark, d):
    log = T.read(spark, d, "events").select(
        F.lit("GET").alias("method"), F.col("event_type").alias("route"),
        (F.col("value") / 100).alias("seconds"),
    )
    return D.latency_histogram(log).withColumn("total_seconds", F.round("total_seconds", 6))


@query(
    "request_counts",
    "SELECT 'GET' AS method, event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END"
    " AS status, count(*) AS requests FROM events GROUP BY 1, 2, 3",
)
def request_counts(spark, d):
    log = T.read(spark, d, "events").select(
        F.lit("GET").alias("method"), F.col("event_type").alias("route"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )
    return D.request_counts(log)


# Box conversions and validity


@query(
    "box_conversions",
    f"WITH {BASE_SQL} SELECT category_id, sum(x+w) AS x2, sum(y+h) AS y2,"
    " round(sum(((x+w/2)/640 - (w/640)/2) * 640), 4) AS yolo_x1, round(sum(w*h/307200), 6) AS area,"
    " count_if(least(w, h) >= 16)::BIGINT AS large FROM truth GROUP BY 1",
)
def box_conversions(spark, d):
    t = T.truth(spark, d)
    corner = t.select(
        "category_id", *"wh", *G.xywh_to_xyxy(*"xywh"),
        ((F.col("x") + F.col("w") / 2) / 640).alias("cx"),
        ((F.col("y") + F.col("h") / 2) / 480).alias("cy"),
        (F.col("w") / 640).alias("nw"),
        (F.col("h") / 480).alias("nh"),
    )
    yolo = G.yolo_to_xyxy("cx", "cy", "nw", "nh", F.lit(640), F.lit(480))
    area = G.area_fraction("x1", "y1", "x2", "y2", F.lit(640), F.lit(480))
    return corner.groupBy("category_id").agg(
        F.sum("x2").alias("x2"),
        F.sum("y2").alias("y2"),
        F.round(F.sum(yolo[0]), 4).alias("yolo_x1"),
        F.round(F.sum(area), 6).alias("area"),
        F.count_if(G.size_bin("w", "h") == ">=16px").alias("large"),
    )


@query(
    "border_corrections",
    f"WITH {BASE_SQL}, s AS (SELECT image_id, category_id, w, CASE annotation_index % 3 WHEN 0 THEN"
    " 640.015::DOUBLE - w WHEN 1 THEN 640.5::DOUBLE - w ELSE x END AS x FROM truth),"
    " r AS (SELECT *, CASE WHEN greatest(0, x + w - 640) > 0.02 THEN 'unnormalizable' WHEN x + w <= 640"
    " THEN 'unchanged' ELSE 'corrected' END AS status FROM s)"
    " SELECT category_id, status, count(*) AS n, round(sum(CASE WHEN status = 'corrected' THEN 640 - x"
    " ELSE w END), 4) AS width FROM r GROUP BY 1, 2",
)
def border_corrections(spark, d):
    shifted = T.truth(spark, d).withColumn(
        "x",
        F.expr(
            "CASE annotation_index % 3 WHEN 0 THEN 640.015D - w WHEN 1 THEN 640.5D - w ELSE x END"
        ),
    )
    fixed = V.border_corrections(shifted, T.images(spark, d))
    return fixed.groupBy("category_id", F.col("fix.status").alias("status")).agg(
        F.count("*").alias("n"), F.round(F.sum("fix.w"), 4).alias("width")
    )


@query(
    "correction_proposals",
    f"WITH {BASE_SQL}, s AS (SELECT image_id, category_id, w, y, 640.015::DOUBLE - w AS x FROM truth"
    " WHERE annotation_index % 3 = 0) SELECT image_id, category_id, y, round(x, 6) AS before_x,"
    " round(w, 6) AS before_w, round(640 - x, 6) AS after_w FROM s",
)
def correction_proposals(spark, d):
    shifted = T.truth(spark, d).withColumn(
        "x",
        F.expr(
            "CASE annotation_index % 3 WHEN 0 THEN 640.015D - w WHEN 1 THEN 640.5D - w ELSE x END"
        ),
    )
    proposals = V.correction_proposals(V.border_corrections(shifted, T.images(spark, d)))
    return proposals.select(
        "image_id", "category_id", F.col("after_y").alias("y"),
        rounded("before_x", 6), rounded("before_w", 6), rounded("after_w", 6),
    )


@query(
    "out_of_bounds_boxes",
    f"WITH {BASE_SQL} SELECT image_id, count(*) AS n FROM truth WHERE x + 30 + w > 640 GROUP BY 1",
)
def out_of_bounds_boxes(spark, d):
    boxes = xyxy(T.truth(spark, d).withColumn("x", F.col("x") + 30)).withColumn("path", F.col("image_id"))
    found = V.out_of_bounds_issues(boxes, T.images(spark, d).withColumn("path", F.col("image_id")))
    return found.select(F.get("images", F.lit(0)).cast("bigint").alias("image_id"), "n")


@query(
    "unknown_classes",
    f"WITH {BASE_SQL} SELECT image_id, count(*) AS n FROM truth WHERE category_id NOT IN (1, 2, 3) GROUP BY 1",
)
def unknown_classes(spark, d):
    annotations = T.truth(spark, d).select(
        F.col("image_id").alias("path"), F.col("category_id").alias("class_id")
    )
    found = V.unknown_class_issues(annotations, spark.range(1, 4).withColumnRenamed("id", "class_id"))
    return found.select(F.get("images", F.lit(0)).cast("bigint").alias("image_id"), "n")


@query(
    "reference_errors",
    f"WITH {BASE_SQL}, a AS (SELECT image_id + (category_id // 5) * 100000000 AS image_id, category_id FROM truth)"
    " SELECT 'unknown_image' AS reason, count(*) AS n FROM a WHERE image_id NOT IN (SELECT image_id FROM imgs)"
    " UNION ALL SELECT 'unknown_category', count(*) FROM a WHERE category_id > 3",
)
def reference_errors(spark, d):
    a = T.truth(spark, d).select(
        F.lit("all").alias("split"),
        F.expr("image_id + (category_id div 5) * 100000000").alias("image_id"),
        "category_id",
    )
    images = T.images(spark, d).withColumn("split", F.lit("all"))
    known = spark.range(1, 4).select(F.lit("all").alias("split"), F.col("id").alias("category_id"))
    return V.reference_errors(a, images, known).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "coco_issues",
    f"WITH {BASE_SQL}, a AS (SELECT t.image_id, t.image_id * 8 + annotation_index // 576460752303423488 AS id,"
    " category_id, x - 10 AS x, y, round(w / 20) * 20 AS w, h FROM truth t),"
    " i AS (SELECT id, count(*) AS k FROM a GROUP BY 1),"
    " b AS (SELECT image_id, category_id, x, y, w, h, count(*) AS k FROM a GROUP BY ALL HAVING count(*) > 1)"
    " SELECT 'duplicate_annotation_id' AS code, count(*) AS findings, sum(k - 1)::BIGINT AS n FROM i WHERE k > 1"
    " UNION ALL SELECT 'invalid_box', count(*), count(*) FROM a WHERE x < 0 OR w <= 0"
    " UNION ALL SELECT 'duplicate_box', count(*), sum(k)::BIGINT FROM (SELECT image_id, sum(k - 1) AS k FROM b GROUP BY 1)"
    " HAVING count(*) > 0",
)
def coco_issues(spark, d):
    a = T.truth(spark, d).select(
        F.lit("all").alias("split"),
        F.col("image_id").cast("string").alias("file"),
        F.expr("image_id * 8 + annotation_index div 576460752303423488").alias("annotation_id"),
        "category_id",
        (F.col("x") - 10).alias("x"),
        "y",
        (F.round(F.col("w") / 20) * 20).alias("w"),
        "h",
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
    )
    a = a.withColumn("bbox", F.array(*"xywh"))
    return V.coco_issues(a).groupBy("code").agg(
        F.count("*").alias("findings"), F.sum("n").alias("n")
    )


# Files


@query(
    "content_issues",
    f"WITH {FILES_SQL}, p AS (SELECT path, count(*) AS k FROM docs GROUP BY 1),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY actual_sha256 ORDER BY ordinal) AS r FROM docs),"
    " x AS (SELECT *, row_number() OVER q AS r, first(sha256) OVER q AS fs FROM docs"
    " WINDOW q AS (PARTITION BY pixel_sha256 ORDER BY ordinal))"
    " SELECT 'checksum_mismatch' AS code, count(*) AS n FROM docs WHERE sha256 <> actual_sha256"
    " UNION ALL SELECT 'duplicate_path', sum(k - 1)::BIGINT FROM p WHERE k > 1 HAVING count(*) > 0"
    " UNION ALL SELECT 'duplicate_bytes', count(*) FROM b WHERE r > 1 HAVING count(*) > 0"
    " UNION ALL SELECT 'duplicate_pixels', count(*) FROM x WHERE r > 1 AND actual_sha256 <> fs HAVING count(*) > 0"
    " UNION ALL SELECT 'dimension_mismatch', count(*) FROM docs WHERE width <> actual_width",
)
def content_issues(spark, d):
    files = T.document_files(spark, d)
    plain = files.withColumn("path", F.col("image_id").cast("string"))
    decoded = plain.select("path", F.col("actual_width").alias("width"), "height")
    found = V.union_issues(
        V.checksum_issues(plain, plain),
        V.duplicate_path_issues(files),
        V.duplicate_byte_issues(plain),
        V.duplicate_pixel_issues(plain),
        V.dimension_issues(plain, decoded),
    )
    return found.groupBy("code").agg(F.sum("n").alias("n"))


@query(
    "repeats_of_first",
    f"WITH {FILES_SQL}, x AS (SELECT ordinal, row_number() OVER q AS r, first(ordinal) OVER q AS f FROM docs"
    " WINDOW q AS (PARTITION BY actual_sha256 ORDER BY ordinal))"
    " SELECT f AS first_doc, ordinal AS doc FROM x WHERE r > 1",
)
def repeats_of_first(spark, d):
    files = T.document_files(spark, d).withColumn("path", F.col("image_id").cast("string"))
    again = V.repeats_of_first(files, "actual_sha256")
    return again.select(
        F.col("first_path").cast("bigint").alias("first_doc"), F.col("ordinal").alias("doc")
    )


@query(
    "duplicate_groups",
    f"WITH {FILES_SQL} SELECT sha256, count(*) AS images, string_agg(DISTINCT split, ',' ORDER BY split) AS splits,"
    " count(DISTINCT split) > 1 AS crosses_splits FROM docs GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_groups(spark, d):
    return V.duplicate_groups(T.document_files(spark, d), "sha256")


@query(
    "byte_mismatches",
    f"WITH {FILES_SQL} SELECT image_id, split FROM docs WHERE sha256 <> actual_sha256",
)
def byte_mismatches(spark, d):
    files = T.document_files(spark, d).withColumn("file", F.col("image_id").cast("string"))
    other = files.withColumn("sha256", F.col("actual_sha256"))
    return V.byte_mismatches(files, other).select(F.col("file").cast("bigint").alias("image_id"), "split")


@query(
    "file_digests",
    "SELECT doc_id, sha256(text) AS sha256 FROM documents",
)
def file_digests(spark, d):
    return T.read(spark, d, "documents").select(
        "doc_id", H.byte_digest(F.encode("text", "UTF-8")).alias("sha256")
    )


_DIGEST_SQL = """WITH l0 AS (SELECT d || ':' || count(*) AS d, count(*) AS n FROM (SELECT sha256('{"c_custkey":' || c_custkey ||
  ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS d FROM customer) GROUP BY d),
 l1 AS (SELECT substr(d, 1, 8) || sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l0 GROUP BY substr(d, 1, 8)),
 l2 AS (SELECT substr(d, 1, 5) || sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l1 GROUP BY substr(d, 1, 5)),
 l3 AS (SELECT substr(d, 1, 2) || sha256(string_agg(d, ',' ORDER BY d)) AS d, sum(n) AS n FROM l2 GROUP BY substr(d, 1, 2))
"""


@query(
    "table_digest",
    _DIGEST_SQL + "SELECT sum(n)::BIGINT AS rows, sha256(string_agg(d, ',' ORDER BY d)) AS digest FROM l3",
)
def table_digest(spark, d):
    return H.table_digest(T.read(spark, d, "customer").drop("c_acctbal"))


@query(
    "stable_ids",
    "SELECT doc_id, 'image-' || sha256('[\"' || source || '\",\"' || lang || '\",\"' || doc_id || '\"]') AS image_id"
    " FROM documents",
)
def stable_ids(spark, d):
    return T.read(spark, d, "documents").select(
        "doc_id", X.stable_id("image", "source", "lang", "doc_id").alias("image_id")
    )


@query(
    "record_digests",
    "SELECT s_suppkey, sha256('{\"key\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"nation\":' ||"
    " s_nationkey || '}') AS digest FROM supplier",
)
def record_digests(spark, d):
    return T.read(spark, d, "supplier").select(
        "s_suppkey",
        X.record_digest(name="s_name", nation="s_nationkey", key="s_suppkey").alias("digest"),
    )


@query(
    "page_paths",
    "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', CASE WHEN page_id % 5 = 0 THEN '/'"
    " WHEN page_id % 7 = 0 THEN '../' ELSE '' END) AS path FROM pages)"
    " SELECT page_id, path, NOT (path LIKE '/%' OR path LIKE '../%' OR path LIKE '%/../%'"
    " OR path LIKE '%/..') AS safe, split_part(split_part(path, '/', -1), '.rf.', 1) AS family,"
    " CASE WHEN path LIKE '%.html' THEN left(path, length(path) - 5) ELSE path END AS pair_key FROM p",
)
def page_paths(spark, d):
    pages = T.read(spark, d, "pages").select(
        "page_id",
        F.regexp_replace(
            F.col("url"),
            F.lit("^https?://"),
            F.when(F.col("page_id") % 5 == 0, "/").when(F.col("page_id") % 7 == 0, "../").otherwise(""),
        ).alias("path"),
    )
    return pages.select(
        "page_id",
        "path",
        X.safe_path("path").alias("safe"),
        X.source_family("path", "export").alias("family"),
        X.pair_key("path", ".html").alias("pair_key"),
    )


# Splits, classes and coverage


@query(
    "split_class_counts",
    f"WITH {BASE_SQL} SELECT s AS split, c.category_id::BIGINT AS class_id, count(t.image_id) AS annotations FROM"
    f" (SELECT unnest(['train', 'validation', 'test']) AS s) CROSS JOIN {CLASS_SQL} c LEFT JOIN"
    " (SELECT t.image_id, split, category_id FROM truth t JOIN imgs USING (image_id)) t ON t.split = s AND"
    " t.category_id = c.category_id GROUP BY 1, 2",
)
def split_class_counts(spark, d):
    images = T.images(spark, d).withColumn("path", F.col("image_id"))
    boxes = T.truth(spark, d).select(
        F.col("image_id").alias("path"), F.col("category_id").alias("class_id")
    )
    classes = categories(spark).withColumnRenamed("category_id", "class_id")
    return V.split_class_counts(images, boxes, classes).drop("name")


@query(
    "split_gates",
    f"WITH {FILES_SQL}, g AS (SELECT group_id FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1)"
    " SELECT 'group_leakage' AS code, group_id AS detail FROM g"
    " UNION ALL SELECT 'empty_split', s FROM (SELECT unnest(['train', 'validation', 'test', 'extra']) AS s)"
    " WHERE s NOT IN (SELECT split FROM docs)"
    " UNION ALL SELECT 'missing_class_coverage', s || ':' || n FROM"
    " (SELECT unnest(['train', 'validation', 'test']) AS s) CROSS JOIN (SELECT unnest(['q0', 'q1', 'q2']) AS n)"
    " WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN docs ON doc_id = image_id WHERE split = s AND"
    " 'q' || quality = n)",
)
def split_gates(spark, d):
    files = T.document_files(spark, d)
    images = files.withColumn("path", F.col("image_id"))
    boxes = T.read(spark, d, "labels").select(
        F.col("doc_id").alias("path"), F.col("quality").cast("bigint").alias("class_id")
    )
    classes = spark.range(3).select(F.col("id").alias("class_id"), F.concat(F.lit("q"), "id").alias("name"))
    found = V.union_issues(
        V.group_leakage_issues(files),
        V.empty_split_issues(files, [*T.SPLITS, "extra"]),
        V.coverage_issues(V.split_class_counts(images, boxes, classes)),
    )
    return found.select("code", "detail")


@query(
    "validation_summary",
    f"WITH {FILES_SQL}, g AS (SELECT group_id FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1),"
    " e AS (SELECT count(*) AS n FROM g), m AS (SELECT count(*) AS n FROM docs WHERE sha256 <> actual_sha256)"
    " SELECT (e.n + m.n) = 0 AS valid, (e.n + m.n) = 0 AS ready_for_training, e.n + m.n AS errors,"
    " 0::BIGINT AS reviews, (SELECT count(*) FROM docs) AS sample_count FROM e, m",
)
def validation_summary(spark, d):
    files = T.document_files(spark, d)
    plain = files.withColumn("path", F.col("image_id").cast("string"))
    found = V.union_issues(V.group_leakage_issues(files), V.checksum_issues(plain, plain))
    return V.validation_summary(found, files.count())


@query(
    "class_remap",
    "WITH a AS (SELECT l_suppkey % 12 AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT"
    " unnest([1, 2, 3, 4, 5, 6, 0]) AS k, unnest([6, 2, 0, 1, 3, 4, NULL]) AS class_id)"
    " SELECT CASE WHEN t.k IS NULL THEN 'unmapped' WHEN class_id IS NULL THEN 'excluded' ELSE 'mapped' END AS status,"
    " coalesce(class_id, -1)::BIGINT AS class_id, sum(n)::BIGINT AS n FROM a LEFT JOIN t USING (k) GROUP BY 1, 2",
)
def class_remap(spark, d):
    # Source categories of one release and the shared classes they mean.
    mapping = [(1, 6), (2, 2), (3, 0), (4, 1), (5, 3), (6, 4), (0, None)]
    taxonomy = spark.createDataFrame(
        [("release", s, c) for s, c in mapping],
        "source string, source_category_id bigint, class_id bigint",
    )
    boxes = T.read(spark, d, "lineitem").select(
        F.lit("release").alias("source"), (F.col("l_suppkey") % 12).alias("source_category_id")
    )
    return (
        V.remap_classes(boxes, taxonomy)
        .groupBy("status", F.coalesce("class_id", F.lit(-1)).alias("class_id"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "class_map_differences",
    "SELECT n_nationkey::BIGINT AS category_id, n_name AS name, 'left' AS only_in FROM nation WHERE n_nationkey % 4 = 0"
    " UNION ALL SELECT n_nationkey::BIGINT, 'x' || n_name, 'right' FROM nation WHERE n_nationkey % 4 = 0",
)
def class_map_differences(spark, d):
    found = T.read(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("category_id"), F.col("n_name").alias("name")
    )
    expected = found.withColumn(
        "name",
        F.when(F.col("category_id") % 4 == 0, F.concat(F.lit("x"), "name")).otherwise(F.col("name")),
    )
    return V.class_map_differences(found, expected)


@query(
    "grouped_split",
    "WITH g AS (SELECT DISTINCT source || lang AS group_id FROM documents), r AS (SELECT group_id, row_number()"
    " OVER (ORDER BY sha256('pcb-v1' || chr(0) || group_id)) AS n FROM g), t AS (SELECT greatest(1,"
    " round_even(count(*) * 0.15, 0)) AS h FROM g) SELECT group_id, CASE WHEN n <= h THEN 'test' WHEN n <= 2 * h"
    " THEN 'validation' ELSE 'train' END AS split FROM r, t",
)
def grouped_split(spark, d):
    groups = T.read(spark, d, "documents").select(F.concat("source", "lang").alias("group_id"))
    return S.grouped_split(groups)


@query(
    "stratified_sample",
    "WITH r AS (SELECT doc_id, sha256('7:' || doc_id) AS h FROM documents), c AS (SELECT doc_id, h, quality FROM r"
    " JOIN labels USING (doc_id)), core AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, row_number() OVER"
    " (PARTITION BY quality ORDER BY h) AS n FROM c) WHERE n <= 16), f AS (SELECT doc_id FROM r WHERE doc_id NOT IN"
    " (SELECT doc_id FROM core) ORDER BY h LIMIT (SELECT 60 - count(*) FROM core))"
    " SELECT doc_id FROM core UNION ALL SELECT doc_id FROM f",
)
def stratified_sample(spark, d):
    documents = T.read(spark, d, "documents").select("doc_id")
    labels = T.read(spark, d, "labels").select("doc_id", F.col("quality").alias("class"))
    return S.stratified_sample(documents, labels, [0, 1], 60, 7, key="doc_id")


@query(
    "training_order",
    "WITH v AS (SELECT p_partkey AS view_id FROM part), s AS (SELECT count(*) AS n FROM v), p AS (SELECT view_id, pass,"
    " row_number() OVER (PARTITION BY pass ORDER BY sha256((5 + pass) || ':' || view_id), view_id) AS place FROM v,"
    " (SELECT unnest(range(3)) AS pass)) SELECT pass::INT AS pass, pass * n + place AS step, (place - 1) // 4 AS batch,"
    " view_id FROM p, s WHERE pass * n + place <= 2 * n + n // 2",
)
def training_order(spark, d):
    views = T.read(spark, d, "part").select(F.col("p_partkey").alias("view_id"))
    n = views.count()
    return S.training_order(views, 5, max_steps=2 * n + n // 2, batch=4)


@query(
    "class_exposures",
    f"WITH {BASE_SQL}, v AS (SELECT image_id, row_number() OVER (ORDER BY sha256('9:' || image_id), image_id) AS place,"
    " count(*) OVER () AS n FROM imgs), w AS (SELECT image_id, CASE WHEN place <= n // 3 THEN 2 ELSE 1 END AS shown FROM v)"
    " SELECT category_id, sum(shown)::BIGINT AS exposures FROM truth t JOIN (SELECT image_id, 1 + CASE WHEN row_number()"
    " OVER (ORDER BY sha256('10:' || image_id), image_id) <= (SELECT count(*) FROM imgs) // 3 THEN 1 ELSE 0 END AS shown"
    " FROM imgs) USING (image_id) GROUP BY 1",
)
def class_exposures(spark, d):
    images = T.images(spark, d).select("image_id")
    n = images.count()
    steps = S.training_order(images, 9, max_steps=n + n // 3, key="image_id")
    return D.class_exposures(steps, T.truth(spark, d))


@query(
    "evenly_spaced",
    "WITH r AS (SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS n, greatest(1, count(*) OVER () // 12) AS s"
    " FROM pages) SELECT url FROM r WHERE n % s = 0 AND n // s < 12",
)
def evenly_spaced(spark, d):
    pages = T.read(spark, d, "pages").select("url", "page_id")
    return S.evenly_spaced(pages, [F.col("url"), F.col("page_id")]).select("url")


@query(
    "first_per_class",
    f"WITH {BASE_SQL}, d AS (SELECT DISTINCT category_id, image_id FROM truth) SELECT category_id, image_id FROM d"
    " QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY image_id) <= 6",
)
def first_per_class(spark, d):
    rows = T.truth(spark, d).select("category_id", "image_id").distinct()
    return S.first_per_class(rows, "category_id", ["image_id"])


_STATS_SQL = f"""WITH {BASE_SQL}, gi AS (SELECT group_id, count(*) AS images FROM imgs GROUP BY 1),
gc AS (SELECT group_id, count_if(category_id = 1)::BIGINT AS c1, count_if(category_id = 2)::BIGINT AS c2,
  count_if(category_id = 3)::BIGINT AS c3 FROM truth JOIN imgs USING (image_id) GROUP BY 1),
st AS (SELECT group_id, images, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3
  FROM gi LEFT JOIN gc USING (group_id)),
tot AS (SELECT sum(images) AS im, sum(c1) AS t1, sum(c2) AS t2, sum(c3) AS t3 FROM st)
"""


@query("group_stats", _STATS_SQL + "SELECT * FROM st")
def group_stats(spark, d):
    return S.group_stats(T.images(spark, d), T.truth(spark, d), [1, 2, 3])


@query(
    "holdout_choices",
    _STATS_SQL + "SELECT a.group_id || '|' || b.group_id AS groups, round(pow((a.images + b.images) / im - 0.15, 2)"
    " + pow((a.c1 + b.c1) / t1 - 0.15, 2) + pow((a.c2 + b.c2) / t2 - 0.15, 2) + pow((a.c3 + b.c3) / t3 - 0.15, 2), 9)"
    " AS score, sha256(a.group_id || '|' || b.group_id) AS tie FROM st a, st b, tot WHERE a.group_id < b.group_id",
)
def holdout_choices(spark, d):
    stats = S.group_stats(T.images(spark, d), T.truth(spark, d), [1, 2, 3])
    return S.holdout_choices(stats, 2).select("groups", rounded("score"), "tie")


@query(
    "holdout_split",
    _STATS_SQL + """, ch AS (SELECT a.group_id AS a, b.group_id AS b, pow((a.images + b.images) / im - 0.15, 2)
    + pow((a.c1 + b.c1) / t1 - 0.15, 2) + pow((a.c2 + b.c2) / t2 - 0.15, 2) + pow((a.c3 + b.c3) / t3 - 0.15, 2)
    AS score, sha256(a.group_id || '|' || b.group_id) AS tie FROM st a, st b, tot WHERE a.group_id < b.group_id),
    te AS (SELECT a, b FROM ch ORDER BY score, tie LIMIT 1),
    va AS (SELECT ch.a, ch.b FROM ch, te WHERE ch.a NOT IN (te.a, te.b) AND ch.b NOT IN (te.a, te.b)
      ORDER BY score, tie LIMIT 1)
    SELECT group_id, CASE WHEN group_id IN (te.a, te.b) THEN 'test' WHEN group_id IN (va.a, va.b) THEN 'validation'
    ELSE 'train' END AS split FROM st, te, va""",
)
def holdout_split(spark, d):
    return S.holdout_split(S.group_stats(T.images(spark, d), T.truth(spark, d), [1, 2, 3]))


_MANY_SQL = """WITH i AS (SELECT o_orderkey AS image_id, 'h' || lpad(CAST(o_custkey % 37 AS VARCHAR), 2, '0') AS group_id FROM orders),
 b AS (SELECT group_id, count(*) FILTER (l_partkey % 5 = 0) AS c1, count(*) FILTER (l_partkey % 5 = 1) AS c2 FROM lineitem JOIN i ON l_orderkey = image_id
  GROUP BY 1), st AS (SELECT group_id, count(*) AS images, any_value(c1) AS c1, any_value(c2) AS c2 FROM i LEFT JOIN b USING (group_id) GROUP BY 1),
 tot AS (SELECT sum(images) AS im, sum(c1) AS t1, sum(c2) AS t2 FROM st),
 pr AS (SELECT a.group_id || '|' || b.group_id AS g, b.group_id AS last, a.group_id AS first, a.images + b.images AS images, a.c1 + b.c1 AS c1, a.c2 + b.c2 AS c2
  FROM st a JOIN st b ON a.group_id < b.group_id),
 qu AS (SELECT p.g || '|' || q.g AS groups, p.images + q.images AS images, p.c1 + q.c1 AS c1, p.c2 + q.c2 AS c2 FROM pr p JOIN pr q ON p.last < q.first),
 sc AS (SELECT groups, pow(images / im - 0.15, 2) + pow(c1 / t1 - 0.15, 2) + pow(c2 / t2 - 0.15, 2) AS score FROM qu, tot)
"""


@query(
    "best_holdouts",
    _MANY_SQL + "SELECT groups, round(score, 12) AS score, sha256(groups) AS tie FROM sc WHERE score <= (SELECT min(score) FROM sc)",
)
def best_holdouts(spark, d):
    """Four of 37 groups: 66,045 choices."""
    images = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.expr("concat('h', lpad(CAST(o_custkey % 37 AS STRING), 2, '0'))").alias("group_id")
    )
    stats = S.group_stats(images, T.truth(spark, d), [1, 2])
    return S.best_holdouts(stats, 4).select("groups", rounded("score", 12), "tie")


# Near duplicates


def _signed(spark, d, column):
    return T.signatures(spark, d).withColumn("signature", F.col(column))


@query(
    "near_signature_links",
    f"WITH {SIGNATURE_SQL}, s AS (SELECT DISTINCT s24 FROM sig) SELECT a.s24 AS a, b.s24 AS b,"
    " bit_count(xor(a.s24, b.s24))::INT AS distance FROM s a JOIN s b ON a.s24 <= b.s24"
    " AND bit_count(xor(a.s24, b.s24)) <= 4",
)
def near_signature_links(spark, d):
    return N.near_links(_signed(spark, d, "s24"), 4, 24)


@query(
    "near_signature_links_wide",
    f"WITH {SIGNATURE_SQL}, s AS (SELECT DISTINCT s63 FROM sig) SELECT a.s63 AS a, b.s63 AS b,"
    " bit_count(xor(a.s63, b.s63))::INT AS distance FROM s a JOIN s b ON a.s63 < b.s63"
    " AND bit_count(xor(a.s63, b.s63)) <= 18",
)
def near_signature_links_wide(spark, d):
    links = N.near_links(_signed(spark, d, "s63"), 18, 63)
    return links.filter(F.col("a") != F.col("b"))


_NEAR_SQL = f"""WITH {SIGNATURE_SQL}, px AS (SELECT *, sha256(s12 || ':' || image_id % 3) AS pixel FROM sig),
np AS (SELECT a.image_id AS first_image_id, b.image_id AS second_image_id, a.split AS first_split,
  b.split AS second_split, bit_count(xor(a.s12, b.s12))::INT AS distance FROM px a JOIN px b
  ON a.ordinal < b.ordinal AND a.split <> b.split AND a.pixel <> b.pixel
  AND bit_count(xor(a.s12, b.s12)) <= 1)
"""


def _pixels(spark, d):
    pixel = F.sha2(F.concat_ws(":", "s12", F.col("image_id") % 3), 256)
    return _signed(spark, d, "s12").withColumn("pixel_sha256", pixel)


@query("near_pairs", _NEAR_SQL + "SELECT * FROM np")
def near_pairs(spark, d):
    images = _pixels(spark, d)
    pairs = N.near_pairs(images, N.near_links(images, 1, 12))
    return pairs.drop("first_ordinal", "second_ordinal")


@query("near_pair_count", _NEAR_SQL + "SELECT count(*) AS near_duplicate_cross_split_pairs FROM np")
def near_pair_count(spark, d):
    images = _pixels(spark, d)
    return N.cross_split_pair_count(images, N.near_links(images, 1, 12))


@query(
    "near_candidates",
    _NEAR_SQL + "SELECT *, (SELECT count(*) FROM np) AS total, (SELECT count(*) > 100 FROM np) AS truncated FROM np"
    " ORDER BY first_image_id, second_image_id LIMIT 100",
)
def near_candidates(spark, d):
    images = _pixels(spark, d)
    links = N.near_links(images, 1, 12)
    return N.first_candidates(images, links).drop("first_ordinal", "second_ordinal")


@query(
    "orientation_links",
    f"""WITH {SIGNATURE_SQL}, d AS (SELECT a.image_id AS first_image_id, b.image_id AS second_image_id,
    a.family AS first_family, b.family AS second_family,
    list_min(list_transform(b.turned, lambda h: bit_count(xor(a.turned[1], h))))::INT AS phash_distance,
    list_min(list_transform(b.turned_b, lambda h: bit_count(xor(a.turned_b[1], h))))::INT AS ahash_distance
    FROM sig a JOIN sig b ON a.ordinal < b.ordinal AND a.family <> b.family)
    SELECT * FROM d WHERE phash_distance <= 5 OR ahash_distance <= 3""",
)
def orientation_links(spark, d):
    rows = T.signatures(spark, d).withColumns({"phash": F.col("turned"), "ahash": F.col("turned_b")})
    return N.orientation_links(rows, 5, 3, 32, 28)


@query(
    "orientation_links_wide",
    f"""WITH {SIGNATURE_SQL}, d AS (SELECT a.image_id AS first_image_id, b.image_id AS second_image_id,
    a.family AS first_family, b.family AS second_family,
    list_min(list_transform(b.turned_63, lambda h: bit_count(xor(a.turned_63[1], h))))::INT AS phash_distance,
    list_min(list_transform(b.turned_64, lambda h: bit_count(xor(a.turned_64[1], h))))::INT AS ahash_distance
    FROM sig a JOIN sig b ON a.ordinal < b.ordinal AND a.family <> b.family)
    SELECT * FROM d WHERE phash_distance <= 12 OR ahash_distance <= 8""",
)
def orientation_links_wide(spark, d):
    """Signatures of 63 and 64 bits within 12 and 8."""
    rows = T.signatures(spark, d).withColumns({"phash": F.col("turned_63"), "ahash": F.col("turned_64")})
    return N.orientation_links(rows)


# Groups


_EDGE_SQL = f"""WITH RECURSIVE {SIGNATURE_SQL}, e AS (SELECT a.image_id AS u, b.image_id AS v FROM sig a JOIN sig b
  ON a.image_id <> b.image_id AND bit_count(xor(a.s24, b.s24)) <= 4),
reach(n, m) AS (SELECT image_id, image_id FROM sig UNION SELECT r.n, e.v FROM reach r JOIN e ON e.u = r.m),
comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1)
"""


def _edges(spark, d):
    images = _signed(spark, d, "s24")
    links = N.near_links(images, 4, 24)
    by = images.select("signature", "image_id")
    hubs = by.groupBy("signature").agg(F.min("image_id").alias("hub"))
    copies = by.join(hubs, "signature").select(F.col("hub").alias("src"), F.col("image_id").alias("dst"))
    between = links.join(hubs.toDF("a", "src"), "a").join(hubs.toDF("b", "dst"), "b").select("src", "dst")
    return images, copies.union(between).withColumn("reason", F.lit("near"))


@query("connected_components", _EDGE_SQL + "SELECT node, component FROM comp")
def connected_components(spark, d):
    images, edges = _edges(spark, d)
    return C.connected_components(edges, nodes=images.select("image_id"))


@query(
    "group_summary",
    _EDGE_SQL + "SELECT component AS group_id, count(*) AS images, string_agg(DISTINCT split, ',' ORDER BY split)"
    " AS splits, count(DISTINCT split) > 1 AS crosses_splits FROM comp JOIN sig ON node = image_id GROUP BY 1",
)
def group_summary(spark, d):
    images, edges = _edges(spark, d)
    summary = R.group_summary(R.assign_groups(images, edges))
    return summary.select("group_id", "images", "splits", "crosses_splits")


@query(
    "partition_violations",
    _EDGE_SQL + "SELECT node AS image_id, CASE WHEN node % 11 = 0 THEN 0 ELSE 2 END::BIGINT AS groups FROM comp"
    " WHERE node % 11 = 0 OR node % 13 = 0",
)
def partition_violations(spark, d):
    images, edges = _edges(spark, d)
    listed = R.assign_groups(images, edges).select("image_id", "group_id")
    broken = listed.filter("image_id % 11 <> 0").union(
        listed.filter("image_id % 13 = 0 AND image_id % 11 <> 0").withColumn("group_id", F.lit(-1).cast("bigint"))
    )
    return R.partition_violations(images, broken)


@query(
    "review_queue",
    _NEAR_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT a.image_id AS u, b.image_id AS v FROM sig a JOIN sig b
    ON a.image_id <> b.image_id AND bit_count(xor(a.s24, b.s24)) <= 4),
    reach(n, m) AS (SELECT image_id, image_id FROM sig UNION SELECT r.n, e.v FROM reach r JOIN e ON e.u = r.m),
    comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1)
    SELECT first_image_id, second_image_id, distance, a.component = b.component AS already_linked FROM np
    JOIN comp a ON a.node = first_image_id JOIN comp b ON b.node = second_image_id""",
)
def review_queue(spark, d):
    images, edges = _edges(spark, d)
    members = R.assign_groups(images, edges)
    pixels = _pixels(spark, d)
    pairs = N.near_pairs(pixels, N.near_links(pixels, 1, 12))
    queue = R.review_queue(pairs, members)
    return queue.select("first_image_id", "second_image_id", "distance", "already_linked")


@query(
    "contradictions",
    _EDGE_SQL + "SELECT DISTINCT least(e.u, e.v) AS src, greatest(e.u, e.v) AS dst FROM e WHERE (e.u + e.v) % 3 = 0",
)
def contradictions(spark, d):
    images, edges = _edges(spark, d)
    members = R.assign_groups(images, edges)
    links = N.near_links(images, 4, 24)
    pairs = N.near_pairs(
        images.withColumn("self", F.col("image_id")), links, different="self", identity=None
    )
    reviewed = pairs.select(
        F.col("first_image_id").alias("src"),
        F.col("second_image_id").alias("dst"),
        F.expr("CASE WHEN (first_image_id + second_image_id) % 3 = 0 THEN 'unrelated' ELSE 'related' END").alias(
            "relationship"
        ),
    )
    return R.contradictions(members, reviewed).select("src", "dst")


@query(
    "quarantine",
    _NEAR_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT a.image_id AS u, b.image_id AS v FROM px a JOIN px b ON a.image_id <> b.image_id
      AND a.pixel = b.pixel), reach(n, m) AS (SELECT image_id, image_id FROM sig UNION SELECT r.n, e.v FROM reach r
      JOIN e ON e.u = r.m), comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1),
    cross_groups AS (SELECT component FROM comp JOIN sig ON node = image_id GROUP BY 1 HAVING count(DISTINCT split) > 1)
    SELECT DISTINCT image_id FROM (SELECT first_image_id AS image_id FROM np WHERE first_split = 'train'
      UNION SELECT second_image_id FROM np WHERE second_split = 'train'
      UNION SELECT image_id FROM sig JOIN comp ON node = image_id WHERE split = 'train'
        AND component IN (SELECT component FROM cross_groups))""",
)
def quarantine(spark, d):
    images = _pixels(spark, d)
    groups = R.assign_groups(images, R.build_links(images)).select("image_id", "group_id")
    return R.quarantine(images, N.near_links(images, 1, 12), groups)


@query(
    "train_without_quarantine",
    _NEAR_SQL + "SELECT image_id FROM sig WHERE split = 'train' AND image_id NOT IN (SELECT first_image_id FROM np"
    " UNION SELECT second_image_id FROM np)",
)
def train_without_quarantine(spark, d):
    images = _pixels(spark, d)
    alone = images.select("image_id", F.col("image_id").alias("group_id"))
    excluded = R.quarantine(images, N.near_links(images, 1, 12), alone)
    return R.without(images.filter("split = 'train'"), excluded).select("image_id")


@query(
    "shared_pixels",
    f"WITH {FILES_SQL} SELECT sha256 FROM docs WHERE split = 'train' INTERSECT SELECT sha256 FROM docs"
    " WHERE split = 'validation'",
)
def shared_pixels(spark, d):
    files = T.document_files(spark, d)
    return R.shared_values(files.filter("split = 'train'"), files.filter("split = 'validation'"), "sha256")


@query(
    "image_pairs",
    "WITH a AS (SELECT c_custkey AS image_id, substr(c_name, 10) AS pair_key, CASE WHEN c_custkey % 2 = 0 THEN 'train'"
    " ELSE 'test' END AS split FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT s_suppkey + 1000000 AS image_id,"
    " substr(s_name, 10) AS pair_key, CASE WHEN s_suppkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM supplier"
    " UNION ALL SELECT s_suppkey + 2000000, substr(s_name, 10), CASE WHEN s_suppkey % 2 = 0 THEN 'train' ELSE 'test' END"
    " FROM supplier WHERE s_suppkey % 5 = 0), x AS (SELECT pair_key, split, count(*) AS n FROM a GROUP BY 1, 2),"
    " y AS (SELECT pair_key, split, count(*) AS n FROM b GROUP BY 1, 2)"
    " SELECT pair_key, split, CASE WHEN y.n IS NULL THEN 'missing_normal' WHEN x.n IS NULL THEN 'missing_defect'"
    " WHEN x.n > 1 OR y.n > 1 THEN 'not_one_to_one' ELSE 'paired' END AS status FROM x FULL JOIN y USING (pair_key, split)",
)
def image_pairs(spark, d):
    def side(df, key, name):
        return df.select(
            F.col(key).alias("image_id"),
            F.expr(f"substr({name}, 10)").alias("pair_key"),
            F.expr(f"CASE WHEN {key} % 2 = 0 THEN 'train' ELSE 'test' END").alias("split"),
        )

    defects = side(T.read(spark, d, "customer").filter("c_custkey % 7 <> 0"), "c_custkey", "c_name")
    normals = side(T.read(spark, d, "supplier"), "s_suppkey", "s_name")
    twice = normals.union(normals.filter("image_id % 5 = 0"))
    return R.pair_images(defects, twice).select("pair_key", "split", "status")


@query(
    "star_links",
    f"WITH {FILES_SQL} SELECT min(image_id) OVER (PARTITION BY pixel_sha256) AS src, image_id AS dst FROM docs"
    " QUALIFY src <> dst",
)
def star_links(spark, d):
    return R.star_links(T.document_files(spark, d), "pixel_sha256", "identical_decoded_pixels").select("src", "dst")


# Tiles and suppression


@query(
    "tile_grid",
    "WITH i AS (SELECT p_partkey AS image_id, 640 + (p_partkey * 7) % 3000 AS w, 480 + (p_partkey * 11) % 2000 AS h FROM part),"
    " s AS (SELECT *, greatest(w - 1024, 0) AS lx, greatest(h - 1024, 0) AS ly FROM i),"
    " xs AS (SELECT image_id, w, h, lx, ly, unnest(list_distinct(list_append(range(0, lx + 1, 768), lx))) AS tx1 FROM s),"
    " t AS (SELECT *, unnest(list_distinct(list_append(range(0, ly + 1, 768), ly))) AS ty1 FROM xs)"
    " SELECT image_id, tx1::INT AS tx1, ty1::INT AS ty1, least(w, tx1 + 1024)::INT AS tx2, least(h, ty1 + 1024)::INT AS ty2 FROM t",
)
def tile_grid(spark, d):
    images = T.read(spark, d, "part").select(
        F.col("p_partkey").alias("image_id"),
        F.expr("CAST(640 + (p_partkey * 7) % 3000 AS INT)").alias("width"),
        F.expr("CAST(480 + (p_partkey * 11) % 2000 AS INT)").alias("height"),
    )
    return L.tile_grid(images, 1024, 256).select("image_id", "tx1", "ty1", "tx2", "ty2")


_TILE_SQL = f"""WITH {BASE_SQL}, tl AS (SELECT image_id, a AS tx1, b AS ty1, a + 256 AS tx2, b + 256 AS ty2 FROM imgs,
 (SELECT unnest([0, 192, 384]) AS a), (SELECT unnest([0, 192, 224]) AS b))
"""


def _tiles(spark, d):
    return L.tile_grid(T.images(spark, d), 256, 64)


@query(
    "tile_annotations",
    _TILE_SQL + "SELECT l.image_id, tx1, ty1, count(t.image_id) AS labels, coalesce(round(sum(least(x + w, tx2) - greatest(x, tx1)) FILTER (t.image_id IS NOT NULL), 4), 0)"
    " AS width FROM tl l LEFT JOIN truth t ON t.image_id = l.image_id AND x < tx2 AND x + w > tx1 AND y < ty2 AND y + h > ty1"
    " GROUP BY 1, 2, 3",
)
def tile_annotations(spark, d):
    tiles = _tiles(spark, d)
    boxes = xyxy(T.truth(spark, d)).withColumn("class_id", F.col("category_id") - 1)
    labels = L.tile_annotations(tiles, boxes, cell=256.0)
    return (
        labels.groupBy("image_id", "tx1", "ty1")
        .agg(
            F.count("annotation_index").alias("labels"),
            F.coalesce(F.round(F.sum(F.col("x2") - F.col("x1")), 4), F.lit(0.0)).alias("width"),
        )
    )


@query(
    "image_views",
    _TILE_SQL + "SELECT image_id, tx1, ty1 FROM tl JOIN (SELECT image_id FROM imgs WHERE split = 'validation'"
    " ORDER BY image_id LIMIT 50) USING (image_id)",
)
def image_views(spark, d):
    views = L.image_views(T.images(spark, d), "validation", 256, 64, limit=50)
    return views.select("image_id", "tx1", "ty1")


NMS_SQL = f"""WITH {BASE_SQL}, bx AS (SELECT image_id // 8 AS image_id, prediction_index % 576460752303423488 * 8 + image_id % 8 AS prediction_index, category_id,
  score, x, y, w, h FROM preds), q AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id
  ORDER BY score DESC, prediction_index) AS rk FROM bx),
sp AS (SELECT a.image_id, a.category_id, a.rk AS win, b.rk AS lose FROM q a JOIN q b ON a.image_id = b.image_id
  AND a.category_id = b.category_id AND a.rk < b.rk AND a.x < b.x+b.w AND b.x < a.x+a.w AND a.y < b.y+b.h AND b.y < a.y+a.h
  AND (least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) /
   (a.w*a.h+b.w*b.h-(least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))) > 0.3),
wl AS (SELECT image_id, category_id, lose AS rk, list(win) AS wins FROM sp GROUP BY 1, 2, 3),
rw AS (SELECT q.image_id, q.category_id, q.rk, coalesce(wins, []) AS wins FROM q LEFT JOIN wl USING (image_id, category_id, rk)),
nms AS (WITH RECURSIVE st(image_id, category_id, rk, kept) AS (
  SELECT image_id, category_id, rk, [rk] FROM rw WHERE rk = 1 UNION ALL
  SELECT r.image_id, r.category_id, r.rk, CASE WHEN list_has_any(s.kept, r.wins) THEN s.kept ELSE list_append(s.kept, r.rk) END
  FROM st s JOIN rw r ON r.image_id = s.image_id AND r.category_id = s.category_id AND r.rk = s.rk + 1)
 SELECT image_id, category_id, rk FROM st WHERE list_contains(kept, rk))
"""


def _crowd(spark, d):
    """Eight images laid over each other, so that boxes of one class do overlap."""
    return T.predictions(spark, d).select(
        F.expr("image_id div 8").alias("image_id"),
        "category_id",
        F.expr("prediction_index % 576460752303423488 * 8 + image_id % 8").alias("prediction_index"),
        "score",
        *"xywh",
    )


@query(
    "suppress_overlaps",
    NMS_SQL + "SELECT q.image_id, q.category_id, score, x, y, w, h FROM q JOIN nms USING (image_id, category_id, rk)",
)
def suppress_overlaps(spark, d):
    kept = L.suppress_overlaps(_crowd(spark, d), 0.3)
    return kept.select("image_id", "category_id", "score", *"xywh")


@query(
    "suppress_overlaps_by_rounds",
    NMS_SQL + "SELECT q.image_id, q.category_id, count(*) AS kept, sum(x) AS sum_x FROM q JOIN nms"
    " USING (image_id, category_id, rk) GROUP BY 1, 2",
)
def suppress_overlaps_by_rounds(spark, d):
    """The same suppression by the execution reserved for crowded groups."""
    boxes = _crowd(spark, d)
    keys = ["image_id", "category_id", "prediction_index"]
    kept = L._keep_by_rounds(boxes, L._suppression_pairs(boxes, 0.3))
    return boxes.join(kept, keys, "left_semi").groupBy("image_id", "category_id").agg(
        F.count("*").alias("kept"), F.sum("x").alias("sum_x")
    )


@query(
    "merge_tiles",
    f"""WITH {BASE_SQL}, bx AS (SELECT image_id, prediction_index, category_id, score,
    greatest(0, least(640, x + 64 - 20)) AS x1, greatest(0, least(480, y)) AS y1,
    greatest(0, least(640, x + w + 64 - 20)) AS x2, greatest(0, least(480, y + h)) AS y2 FROM preds JOIN imgs USING (image_id)),
    q AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, prediction_index) AS rk
      FROM bx WHERE x2 > x1 AND y2 > y1 AND category_id <= 4),
    sp AS (SELECT a.image_id, a.category_id, a.rk AS win, b.rk AS lose FROM q a JOIN q b ON a.image_id = b.image_id
      AND a.category_id = b.category_id AND a.rk < b.rk AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
      AND (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) /
       ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-(least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))) > 0.5),
    wl AS (SELECT image_id, category_id, lose AS rk, list(win) AS wins FROM sp GROUP BY 1, 2, 3),
    rw AS (SELECT q.image_id, q.category_id, q.rk, coalesce(wins, []) AS wins FROM q LEFT JOIN wl USING (image_id, category_id, rk)),
    nms AS (WITH RECURSIVE st(image_id, category_id, rk, kept) AS (
      SELECT image_id, category_id, rk, [rk] FROM rw WHERE rk = 1 UNION ALL
      SELECT r.image_id, r.category_id, r.rk, CASE WHEN list_has_any(s.kept, r.wins) THEN s.kept ELSE list_append(s.kept, r.rk) END
      FROM st s JOIN rw r ON r.image_id = s.image_id AND r.category_id = s.category_id AND r.rk = s.rk + 1)
     SELECT image_id, category_id, rk FROM st WHERE list_contains(kept, rk))
    SELECT image_id, category_id, score, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM q JOIN nms USING (image_id, category_id, rk)""",
)
def merge_tiles(spark, d):
    tiles = T.images(spark, d).select(
        "image_id", F.lit(0).alias("tile"), F.lit(64).alias("tx1"), F.lit(0).alias("ty1"), "width", "height"
    )
    local = T.predictions(spark, d).select(
        "image_id", F.lit(0).alias("tile"), "prediction_index", "category_id", "score",
        *G.xywh_to_xyxy(F.col("x") - 20, "y", "w", "h"),
    )
    return L.merge_tiles(local, tiles, 4).select("image_id", "category_id", "score", *"xywh")
