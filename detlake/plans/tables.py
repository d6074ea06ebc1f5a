"""How the supplied tables stand in for detection data.

Boxes, splits, signatures and job states are derived with integer arithmetic only, so
that a second SQL engine derives exactly the same rows from ``BASE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = [1, 2, 3, 4, 5]
SPLITS = ["train", "validation", "test"]
WIDTH, HEIGHT = 640, 480

# Bits of a box ordinal: line number, part, supplier, quantity.
_ORDINAL = (
    "l_linenumber * 576460752303423488 + (l_partkey % 536870912) * 1073741824"
    " + (l_suppkey % 16777216) * 64 + CAST(l_quantity AS BIGINT) % 64"
)

BASE_SQL = f"""
box_base AS (SELECT l_orderkey AS image_id, l_partkey, l_suppkey, l_quantity,
   CAST({_ORDINAL} AS BIGINT) AS idx FROM lineitem),
truth AS (SELECT image_id, idx AS annotation_index, CAST(l_partkey % 5 + 1 AS BIGINT) AS category_id,
   CAST((l_partkey*37) % 560 AS DOUBLE) AS x, CAST((l_partkey*53) % 400 AS DOUBLE) AS y,
   16.0::DOUBLE + l_quantity AS w, CAST(16 + (l_suppkey*11) % 50 AS DOUBLE) AS h FROM box_base),
preds AS (SELECT image_id, idx AS prediction_index,
   CAST(CASE WHEN l_suppkey % 10 = 0 THEN (l_partkey+1) % 5 ELSE l_partkey % 5 END + 1 AS BIGINT)
     AS category_id,
   CAST((l_partkey*37) % 560 + l_suppkey % 9 AS DOUBLE) AS x, CAST((l_partkey*53) % 400 AS DOUBLE) AS y,
   16.0::DOUBLE + l_quantity AS w, CAST(16 + (l_suppkey*11) % 50 AS DOUBLE) AS h,
   CAST((l_partkey*7 + l_suppkey*13) % 101 AS DOUBLE) / 100 AS score FROM box_base),
imgs AS (SELECT o_orderkey AS image_id, 'g' || CAST(o_custkey % 13 AS VARCHAR) AS group_id,
   CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'validation'
   ELSE 'test' END AS split FROM orders),
pairs AS (SELECT p.image_id, p.prediction_index, p.category_id AS p_class, p.score,
   t.annotation_index, t.category_id AS t_class,
   (least(p.x+p.w,t.x+t.w)-greatest(p.x,t.x))*(least(p.y+p.h,t.y+t.h)-greatest(p.y,t.y)) AS inter,
   p.w*p.h+t.w*t.h AS area FROM preds p JOIN truth t ON p.image_id = t.image_id
   AND p.x < t.x+t.w AND t.x < p.x+p.w AND p.y < t.y+t.h AND t.y < p.y+p.h),
iou_pairs AS (SELECT *, inter/(area-inter) AS iou FROM pairs)
"""

# Greedy matching, spelled out: predictions of one image and class are visited by
# falling score; each takes its best free truth.
MATCH_SQL = (
    BASE_SQL
    + """,
cand AS (SELECT image_id, p_class AS category_id, prediction_index, score,
   list({'ai': annotation_index, 'iou': iou} ORDER BY iou DESC, annotation_index) AS c
   FROM iou_pairs WHERE p_class = t_class AND iou >= 0.5 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id
   ORDER BY score DESC, prediction_index) AS rk FROM cand),
walk AS (
 WITH RECURSIVE step(image_id, category_id, rk, prediction_index, used, pick) AS (
  SELECT image_id, category_id, rk, prediction_index, [c[1].ai], c[1].ai FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.image_id, r.category_id, r.rk, r.prediction_index,
    CASE WHEN len(list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))) > 0
      THEN list_append(s.used, list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))[1].ai)
      ELSE s.used END,
    CASE WHEN len(list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))) > 0
      THEN list_filter(r.c, lambda e: NOT list_contains(s.used, e.ai))[1].ai ELSE NULL END
  FROM step s JOIN ranked r ON r.image_id = s.image_id AND r.category_id = s.category_id
    AND r.rk = s.rk + 1)
 SELECT image_id, category_id, prediction_index, pick FROM step),
best AS (SELECT image_id, prediction_index, max(iou) AS iou_any,
   max(CASE WHEN p_class = t_class THEN iou END) AS iou_same FROM iou_pairs GROUP BY 1, 2),
matches AS (SELECT p.image_id, p.prediction_index, p.category_id, p.score, k.pick AS annotation_index,
   coalesce(b.iou_same, 0.0::DOUBLE) AS iou_same, coalesce(b.iou_any, 0.0::DOUBLE) AS iou_any,
   CASE WHEN k.pick IS NOT NULL THEN 'matched' WHEN coalesce(b.iou_same, 0) >= 0.5 THEN 'duplicate'
     WHEN coalesce(b.iou_any, 0) >= 0.5 THEN 'class_confusion'
     WHEN coalesce(b.iou_any, 0) > 0 THEN 'partial_overlap' ELSE 'no_overlap' END AS outcome
   FROM preds p LEFT JOIN walk k USING (image_id, prediction_index)
   LEFT JOIN best b USING (image_id, prediction_index))
"""
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _box_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        F.expr(_ORDINAL).cast("bigint").alias("idx"),
    )


_GEOMETRY = {
    "x": "CAST((l_partkey * 37) % 560 AS DOUBLE)",
    "y": "CAST((l_partkey * 53) % 400 AS DOUBLE)",
    "w": "16.0D + l_quantity",
    "h": "CAST(16 + (l_suppkey * 11) % 50 AS DOUBLE)",
}


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_base(spark, sf_dir).select(
        "image_id",
        F.col("idx").alias("annotation_index"),
        F.expr("CAST(l_partkey % 5 + 1 AS BIGINT)").alias("category_id"),
        *[F.expr(e).alias(n) for n, e in _GEOMETRY.items()],
    )


def predictions(spark: SparkSession, sf_dir: str, told: bool = False) -> DataFrame:
    """``told``: scores that tell wrong classes from right ones."""
    score = "CAST((l_partkey * 7 + l_suppkey * 13) % 101 AS DOUBLE)"
    told_score = f"CASE WHEN l_suppkey % 10 = 0 THEN {score} / 250 + 0.1D ELSE {score} / 125 + 0.2D END"
    shifted = {**_GEOMETRY, "x": "CAST((l_partkey * 37) % 560 + l_suppkey % 9 AS DOUBLE)"}
    flipped = (
        "CAST(CASE WHEN l_suppkey % 10 = 0 THEN (l_partkey + 1) % 5 ELSE l_partkey % 5 END + 1"
        " AS BIGINT)"
    )
    return _box_base(spark, sf_dir).select(
        "image_id",
        F.col("idx").alias("prediction_index"),
        F.expr(flipped).alias("category_id"),
        *[F.expr(e).alias(n) for n, e in shifted.items()],
        F.expr(told_score if told else f"{score} / 100").alias("score"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.expr("concat('g', CAST(o_custkey % 13 AS STRING))").alias("group_id"),
        F.expr(
            "CASE WHEN o_orderkey % 20 < 14 THEN 'train'"
            " WHEN o_orderkey % 20 < 17 THEN 'validation' ELSE 'test' END"
        ).alias("split"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
    )

# Signatures: sign bits of embedding dimensions. The label stands for a family, the
# vector number for everything else an image has.
SIGNATURE_SQL = """
sig AS (SELECT vec_id AS image_id, vec_id AS ordinal, 'f' || CAST(label AS VARCHAR) AS family,
   CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split,
   list_sum(list_transform(range(24), lambda i: CASE WHEN embedding[i+1] > 0 THEN 1::BIGINT << i
     ELSE 0 END))::BIGINT AS s24,
   list_sum(list_transform(range(12), lambda i: CASE WHEN embedding[i+1] > 0 THEN 1::BIGINT << i
     ELSE 0 END))::BIGINT AS s12,
   list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i+1] > 0 THEN 1::BIGINT << i
     ELSE 0 END))::BIGINT AS s63,
   list_transform([0, 8, 16, 24], lambda r: list_sum(list_transform(range(32), lambda i:
     CASE WHEN embedding[(i + r) % 32 + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT) AS turned,
   list_transform([0, 7, 14, 21], lambda r: list_sum(list_transform(range(28), lambda i:
     CASE WHEN embedding[(i + r) % 28 + 33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT) AS turned_b,
   list_transform([0, 8, 16, 24], lambda r: list_sum(list_transform(range(63), lambda i:
     CASE WHEN embedding[(i + r) % 32 + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT) AS turned_63,
   list_transform([0, 8, 16, 24], lambda r: list_sum(list_transform(range(64), lambda i:
     CASE WHEN embedding[(i + r) % 32 + 33] > 0 THEN 1::HUGEINT << i ELSE 0 END))::HUGEINT) AS turned_64
   FROM embeddings)
"""


def _sign_bits(bits: int, place: str = "i") -> str:
    return (
        f"aggregate(sequence(0, {bits - 1}), 0L, (acc, i) -> acc | CASE WHEN embedding[{place}] > 0"
        " THEN shiftleft(1L, i) ELSE 0L END)"
    )


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.col("vec_id").alias("ordinal"),
        F.expr("concat('f', CAST(label AS STRING))").alias("family"),
        F.expr(
            "CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'validation'"
            " ELSE 'test' END"
        ).alias("split"),
        F.expr(_sign_bits(24)).alias("s24"),
        F.expr(_sign_bits(12)).alias("s12"),
        F.expr(_sign_bits(63)).alias("s63"),
        F.expr(
            f"transform(array(0, 8, 16, 24), r -> {_sign_bits(32, '(i + r) % 32')})"
        ).alias("turned"),
        F.expr(
            f"transform(array(0, 7, 14, 21), r -> {_sign_bits(28, '(i + r) % 28 + 32')})"
        ).alias("turned_b"),
        F.expr(
            f"transform(array(0, 8, 16, 24), r -> {_sign_bits(63, '(i + r) % 32')})"
        ).alias("turned_63"),
        F.expr(
            f"transform(array(0, 8, 16, 24), r -> {_sign_bits(64, '(i + r) % 32 + 32')})"
        ).alias("turned_64"),
    )


# Documents as image files: the text is the content, its source the board group.
FILES_SQL = """
docs AS (SELECT doc_id AS image_id, doc_id AS ordinal,
   'images/' || CAST(doc_id % 990 AS VARCHAR) || '.png' AS path, sha256(text) AS sha256,
   CASE WHEN doc_id % 97 = 0 THEN sha256(lang || text) ELSE sha256(text) END AS actual_sha256,
   sha256(lower(text)) AS pixel_sha256, 'b' || source || lang AS group_id,
   CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END
     AS split, lang, n_chars,
   CAST(64 + n_chars % 7 AS INT) AS width, 64 AS height,
   CAST(64 + n_chars % 7 + CASE WHEN doc_id % 89 = 0 THEN 1 ELSE 0 END AS INT) AS actual_width
   FROM documents)
"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"),
        F.col("doc_id").alias("ordinal"),
        F.expr("concat('images/', CAST(doc_id % 990 AS STRING), '.png')").alias("path"),
        F.expr("sha2(text, 256)").alias("sha256"),
        F.expr(
            "CASE WHEN doc_id % 97 = 0 THEN sha2(concat(lang, text), 256) ELSE sha2(text, 256) END"
        ).alias("actual_sha256"),
        F.expr("sha2(lower(text), 256)").alias("pixel_sha256"),
        F.expr("concat('b', source, lang)").alias("group_id"),
        F.expr(
            "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation'"
            " ELSE 'test' END"
        ).alias("split"),
        "lang",
        "n_chars",
        F.expr("CAST(64 + n_chars % 7 AS INT)").alias("width"),
        F.lit(64).alias("height"),
        F.expr(
            "CAST(64 + n_chars % 7 + CASE WHEN doc_id % 89 = 0 THEN 1 ELSE 0 END AS INT)"
        ).alias("actual_width"),
    )
