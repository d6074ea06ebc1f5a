"""JSON documents: manifests, COCO, saved predictions, reviews, run artifacts.

Documents are read with a declared schema, one file per document, then exploded into
flat tables that are meant to be written to Parquet once and reused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake import schemas


def strict_json(
    spark: SparkSession, path: str, schema: str, limit: int = 20_000_000
) -> DataFrame:
    """Documents under ``path``; oversized, malformed or ambiguous ones fail the read.

    ``parse_json`` refuses duplicate keys, which a schema read would silently resolve,
    and NaN or infinite numbers. The length is checked before the content is parsed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.when(
        F.col("length") > limit, F.raise_error(F.lit("JSON exceeds size limit")).cast("binary")
    ).otherwise(F.col("content"))
    checked = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.decode(text, "UTF-8").alias("body"),
    ).withColumn("body", F.to_json(F.parse_json("body")))
    parsed = F.from_json("body", schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"})
    return checked.select("file_name", parsed.alias("d")).select("file_name", "d.*")


@dataclass
class Coco:
    """Three tables of a COCO export; ``annotations`` keeps its order in ``ordinal``."""

    images: DataFrame
    annotations: DataFrame
    categories: DataFrame


def read_coco(spark: SparkSession, path: str, split: str | None = None) -> Coco:
    documents = spark.read.schema(schemas.COCO).option("multiLine", True).option(
        "mode", "FAILFAST"
    ).json(path)
    if split is not None:
        documents = documents.withColumn("split", F.lit(split))
    else:
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        documents = documents.withColumn(
            "split",
            F.when(name.contains("train"), "train")
            .when(name.contains("val"), "validation")
            .otherwise("test"),
        )
    images = documents.select("split", F.inline("images")).select(
        "split",
        F.col("id").alias("image_id"),
        F.col("file_name").alias("file"),
        "width",
        "height",
        F.col("extra.name").alias("source_name"),
    )
    annotations = documents.select("split", F.posexplode("annotations").alias("ordinal", "a"))
    annotations = annotations.select(
        "split",
        "ordinal",
        F.col("a.id").alias("annotation_id"),
        F.col("a.image_id").alias("image_id"),
        F.col("a.category_id").alias("category_id"),
        F.col("a.bbox").alias("bbox"),
        *[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")],
    )
    categories = documents.select("split", F.inline("categories")).select(
        "split", F.col("id").alias("category_id"), "name"
    )
    return Coco(images, annotations, categories)


@dataclass
class Manifest:
    """Dataset manifests as flat tables plus a header row each.

    ``ordinal`` is the place of an image in its ``document``, the file it comes from.
    """

    header: DataFrame
    classes: DataFrame
    images: DataFrame
    annotations: DataFrame


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    document = spark.read.schema(schemas.MANIFEST).option("multiLine", True).option(
        "mode", "FAILFAST"
    ).json(path)
    samples = document.select(
        F.col("_metadata.file_path").alias("document"), F.posexplode("samples").alias("ordinal", "s")
    )
    images = samples.select(
        "document",
        "ordinal",
        F.col("s.image").alias("path"),
        *[F.col(f"s.{c}") for c in ("sha256", "width", "height", "group_id", "split")],
    )
    annotations = samples.select(
        "document",
        F.col("ordinal").alias("image_ordinal"),
        F.col("s.image").alias("path"),
        F.posexplode("s.annotations").alias("annotation_index", "a"),
    ).select(
        "document",
        "image_ordinal",
        "path",
        "annotation_index",
        "a.class_id",
        *[F.col(f"a.bbox.{c}") for c in ("x1", "y1", "x2", "y2")],
    )
    classes = document.select(F.posexplode("classes").alias("class_id", "name"))
    return Manifest(document.drop("samples", "classes"), classes, images, annotations)


def read_saved_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(evaluated images, predictions) of saved runs, keyed by ``run_id`` and image ordinal."""
    saved = (
        spark.read.schema(schemas.SAVED_PREDICTIONS)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )
    evaluated = saved.select("run_id", F.posexplode("source_images").alias("image_id", "path"))
    rows = saved.select("run_id", F.posexplode("predictions").alias("prediction_index", "p"))
    predictions = rows.select(
        "run_id",
        F.col("p.image_id").alias("image_id"),
        F.col("prediction_index").cast("bigint").alias("prediction_index"),
        F.col("p.category_id").alias("category_id"),
        *[F.get("p.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")],
        F.col("p.score").alias("score"),
    )
    return evaluated.withColumn("image_id", F.col("image_id").cast("bigint")), predictions


def read_review_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per decision, with the hash that identifies its whole batch."""
    from detlake.functions.text import batch_hash

    batches = strict_json(spark, path, schemas.REVIEW_BATCH, 5_000_000)
    return batches.withColumn("batch_hash", batch_hash()).select(
        "file_name",
        "schema_version",
        "packet_sha256",
        "reviewer",
        "reviewed_at",
        "batch_hash",
        F.inline("decisions"),
    )


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    notes = strict_json(spark, path, schemas.NOTES, 2_000_000)
    header = [c for c in notes.columns if c != "notes"]
    return notes.select(*header, F.posexplode("notes").alias("note_index", "n")).select(
        *header, "note_index", "n.*"
    )


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    rows = strict_json(spark, path, schemas.RESOLUTIONS, 2_000_000)
    return rows.select("adjudicator", "reviewed_at", F.inline("decisions"))


def read_run_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON artifact of every run: run_id, artifact, digest and parsed body."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("run_id"),
        F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("artifact"),
        F.sha2("content", 256).alias("sha256"),
        F.parse_json(F.decode("content", "UTF-8")).alias("body"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.HISTORY).option("multiLine", True).option(
        "mode", "FAILFAST"
    ).json(path)
    return rows.withColumn(
        "run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    )
