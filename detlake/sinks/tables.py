"""Write-once tables, releases, audits and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from detlake.functions.hashing import table_digest, table_sums


def _existing(spark: SparkSession, path: str, form: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _is_foreign(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds files that no write of a table has left: neither committed nor aborted."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return False
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return bool(names) and "_temporary" not in names and "_SUCCESS" not in names


def frozen_write(
    df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet"
) -> bool:
    """Write a table once. Writing the same rows again is accepted and changes nothing.

    Returns whether anything was written; different rows at ``path`` are refused, and so is a
    folder with other files. What an aborted write has left is replaced.
    """
    spark = df.sparkSession
    if _is_foreign(spark, path):
        raise ValueError(f"refusing to replace {path}, which is no table")
    before = _existing(spark, path, form, df.schema) if _is_complete(spark, path) else None
    if before is None:
        writer = df.write.mode("overwrite").format(form)
        if form == "parquet":
            # Ids and digests are hexadecimal, which only an entropy code packs.
            writer = writer.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(path)
        return True
    if table_sums(before.select(*df.columns)).first() != table_sums(df).first():
        raise ValueError(f"refusing to change frozen table {path}")
    return False


def _frozen(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet") -> DataFrame:
    """Write once and continue from the files."""
    frozen_write(df, path, partition_by, form)
    return df.sparkSession.read.schema(df.schema).format(form).load(path).select(*df.columns)


def write_release(
    root: str, images: DataFrame, annotations: DataFrame, lineage: DataFrame, version: str
) -> DataFrame:
    """A release: images by split, annotations, lineage, group counts and a metadata row."""
    # Boxes are summed per image where the join has brought them together: only sums travel on.
    counts = (
        annotations.join(images.select("image_id", "group_id"), "image_id")
        .groupBy("image_id", "group_id", "category_id")
        .agg(F.count("*").alias("boxes"))
        .groupBy("group_id", "category_id")
        .agg(F.sum("boxes").alias("boxes"), F.count("*").alias("images"))
    )
    tables = {
        "images": images,
        "annotations": annotations,
        "lineage": lineage,
        "group_counts": counts,
    }
    digests = None
    for name, df in tables.items():
        written = _frozen(df, f"{root}/{name}", ["split"] if name == "images" else None)
        row = table_digest(written).select(
            F.lit(version).alias("version"), F.lit(name).alias("table"), "rows", "digest"
        )
        digests = row if digests is None else digests.unionByName(row)
    return _frozen(digests, f"{root}/release", form="json")


def write_audit(root: str, inventory: DataFrame, findings: DataFrame) -> DataFrame:
    """Inventory and findings as JSON, with the inventory digest in the summary."""
    written = _frozen(inventory, f"{root}/inventory", form="json")
    frozen_write(findings, f"{root}/findings", form="json")
    summary = table_digest(written).select(
        F.col("rows").alias("images"), F.col("digest").alias("inventory_sha256")
    )
    return _frozen(summary, f"{root}/audit", form="json")


def write_research_set(
    root: str, images: DataFrame, corrections: DataFrame, quarantined: DataFrame
) -> DataFrame:
    """Accepted rows, corrections and quarantine, with their counts."""
    parts = {"images": images, "corrections": corrections, "quarantine": quarantined}
    summary = None
    for name, df in parts.items():
        row = _frozen(df, f"{root}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        summary = row if summary is None else summary.union(row)
    return _frozen(summary, f"{root}/summary", form="json")


def write_packet(root: str, packet) -> DataFrame:
    """A review packet (``derive.Packet``) as frozen tables in the order of their ids, with a digest each."""
    from detlake.operators.derive import in_id_order

    tables = {
        "members": in_id_order(packet.members, "image_id"),
        "groups": in_id_order(packet.groups.select("group_id", "image_id"), "group_id", "image_id"),
        "links": in_id_order(packet.links, "src", "dst", "reason"),
        "cases": packet.cases(),
    }
    digests = None
    for name, df in tables.items():
        row = table_digest(_frozen(df, f"{root}/{name}")).select(F.lit(name).alias("table"), "rows", "digest")
        digests = row if digests is None else digests.unionByName(row)
    return _frozen(digests, f"{root}/summary", form="json")


def export_json(df: DataFrame, path: str) -> None:
    """Work lists, decision templates and evidence rows, one JSON object per line."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def evidence(history: DataFrame, checks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One evidence row per run that passed its checks, with totals and artifact digests."""
    from detlake.operators.stats import run_totals

    files = artifacts.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact", "sha256")))).alias(
            "artifact_sha256"
        )
    )
    passed = checks.filter("passed").select("run_id")
    return run_totals(history).join(passed, "run_id", "left_semi").join(files, "run_id", "left")


def complete_reports(root: str):
    """A ``foreachBatch`` sink for reports and their completion events.

    Rows are keyed by (inspection_id, attempt): a replayed batch overwrites the files it
    wrote before, and what an earlier batch has completed is not completed again. Events
    are made from the reports that were written, so both bear the same time.
    """
    keys = ["inspection_id", "attempt"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{root}/reports/batch={batch_id}"
        reports = batch.dropDuplicates(keys)
        placed = StructType([*batch.schema.fields, StructField("batch", LongType())])
        earlier = _existing(spark, f"{root}/reports", "parquet", placed)
        if earlier is not None:
            done = earlier.filter(F.col("batch") < batch_id).select(*keys)
            reports = reports.join(done, keys, "left_anti").select(*batch.columns)
        reports.write.mode("overwrite").parquet(path)
        events = spark.read.schema(batch.schema).parquet(path).select(
            F.concat_ws(":", F.lit("completed"), "inspection_id", "attempt").alias("id"),
            "inspection_id",
            F.lit("inspection_completed").alias("event_type"),
            F.col("completed_at").alias("created_at"),
            F.to_json(F.struct("model_version", "is_demo")).alias("event_data"),
        )
        events.write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}")

    return write


def dead_letters(root: str, issue: str = "issue"):
    """A ``foreachBatch`` sink that parts usable messages from unusable ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter(F.col(issue).isNull()).drop(issue).write.mode("overwrite").parquet(
            f"{root}/accepted/batch={batch_id}"
        )
        batch.filter(F.col(issue).isNotNull()).write.mode("overwrite").parquet(
            f"{root}/dead_letters/batch={batch_id}"
        )

    return write
