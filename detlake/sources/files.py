"""Image files, YOLO label files, object listings and the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake import schemas


def image_files(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}") -> DataFrame:
    """Raw image bytes with their size and time; unread columns are not fetched."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels (BGR order) and dimensions; unreadable files are kept with height -1."""
    rows = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return rows.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("pixels"),
    )


def object_listing(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Stored objects as (image_key, modified_at, length) without reading their content."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    prefix = (root or path).rstrip("/") + "/"
    key = F.substr("path", F.instr("path", prefix) + F.lit(len(prefix)))
    return listing.select(
        key.alias("image_key"), F.col("modificationTime").alias("modified_at"), "length"
    )


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Label lines of every text file, numbered from 1, with the label path."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .withColumn("label_path", F.col("_metadata.file_path"))
    )
    lines = files.select("label_path", F.posexplode(F.split("value", "\\r?\\n")).alias("n", "line"))
    return lines.filter(F.length("line") > 0).select(
        "label_path", (F.col("n") + 1).alias("line_number"), "line"
    )


def label_path_of(image_path) -> F.Column:
    """The YOLO label file that belongs to an image: ``images`` becomes ``labels``, ``.txt``."""
    moved = F.regexp_replace(image_path, r"/images/([^/]*)$", "/labels/$1")
    return F.concat(F.regexp_replace(moved, r"\.[^./]*$", ""), F.lit(".txt"))


def parse_yolo_lines(lines: DataFrame) -> DataFrame:
    """Numbers of each label line and, where it cannot be used, the ``issue``."""
    fields = F.split(F.trim(F.col("line")), r"\s+")
    parsed = lines.withColumn("f", fields)
    for i, name in enumerate(["category", "cx", "cy", "bw", "bh"]):
        parsed = parsed.withColumn(name, F.get("f", F.lit(i)).try_cast("double"))
    numbers = [F.col(n) for n in ("category", "cx", "cy", "bw", "bh")]
    usable = F.lit(True)
    for n in numbers:
        usable = usable & n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    whole = (F.col("category") >= 0) & (F.col("category") == F.floor("category"))
    issue = F.when(F.size("f") != 5, "invalid_yolo_line").when(
        ~(F.coalesce(usable & whole, F.lit(False))), "invalid_yolo_values"
    )
    return parsed.withColumn("issue", issue).drop("f")


_TABLES = {
    "inspections": schemas.INSPECTIONS,
    "inspection_events": schemas.INSPECTION_EVENTS,
    "submission_outbox": schemas.SUBMISSION_OUTBOX,
}


def job_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A Parquet snapshot of one of the job tables."""
    return spark.read.schema(_TABLES[name]).parquet(path)


def job_table_jdbc(
    spark: SparkSession, name: str, url: str, lower: float, upper: float, partitions: int = 32,
    **options: str,
) -> DataFrame:
    """A job table read in parallel ranges of ``created_at``; filters go to the database."""
    if name not in _TABLES:
        raise ValueError(f"unknown job table {name}")
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn="created_at", lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions), **options)
        .load()
    )
