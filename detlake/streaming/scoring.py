"""Continuous scoring: images that arrive in a folder become reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.functions.pixels import image_size
from detlake.operators.scoring import FAILED_CODE, NoDetections, inspection_reports, scored
from detlake.session import stored
from detlake.sinks.tables import complete_reports

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )


def score_images(images: DataFrame, root: str, checkpoint: str, factory=NoDetections):
    """Start the query that writes reports and completion events of arriving images.

    The display policy is the detector's own (``is_experimental``). An image that cannot be
    decoded, or whose detections are unsound, gets no report: it is written to
    ``<root>/failed`` with its error code.
    """
    detector = factory()
    version, demo = detector.version, bool(detector.is_demo)
    experimental = bool(getattr(detector, "is_experimental", False))
    save = complete_reports(root)

    def handle(batch: DataFrame, number: int) -> None:
        named = batch.select(F.col("path").alias("image_id"), "content", image_size("content").alias("size"))
        found = stored(scored(named.filter("size.width > 0").select("image_id", "content"), factory), "scored")
        sizes = named.select("image_id", "size.width", "size.height")
        inspections = sizes.join(found.select("image_id", "inference_time_ms"), "image_id", "left")
        detections = found.select("image_id", F.inline("found"))
        done = stored(inspection_reports(inspections, detections, version, demo, experimental), "reports")
        readable = F.coalesce(F.col("image_width"), F.lit(0)) > 0
        good = (F.col("status") == "COMPLETED") & readable
        save(
            done.filter(good).drop("status", "error_code", "issue", "issues").withColumnRenamed("image_id", "inspection_id").withColumns(
                {"attempt": F.lit(1), "completed_at": F.unix_timestamp().cast("double")}
            ),
            number,
        )
        done.filter(~good).select(
            F.col("image_id").alias("inspection_id"), F.lit(FAILED_CODE).alias("error_code"),
            F.coalesce("issue", F.lit("undecodable")).alias("issue"),
        ).write.mode("overwrite").parquet(f"{root}/failed/batch={number}")

    return (
        images.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
