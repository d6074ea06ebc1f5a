"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text:
``digest``, ``keep_id``, ``group_size``, ``batch``. New rows are reduced to one row per
digest, joined with the index by a sort-merge anti-join that needs no exchange of the
index, and appended. A batch that is offered again changes nothing.

The index lives in a folder: ``facts`` holds one row for the number of buckets and each
generation of the table, ``rows-<generation>`` the table. Any later session opens it with
``open_index``: the number of buckets comes from the folder, never from the session, so the
bucket order survives it. Each batch appends a file to its buckets; ``compact`` writes the next
generation with one sorted file a bucket, whose order the join then takes as it is. Older
generations stay until the folder is cleaned by its owner. One writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.llm.common import fresh, join_by_group, whole_text
from detlake.session import scratch_path

COLUMNS = "digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING"


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the unchanged text in UTF-8; null counts as empty."""
    return F.sha2(F.encode(whole_text(f"`{text}`"), "UTF-8"), 256)


_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Scans of one sorted file a bucket count as sorted while this holds."""
    before = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class DigestIndex:
    """The bucketed digest table in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        known = self._facts()
        if known is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._note(0)
        elif buckets not in (None, known["buckets"]):
            raise ValueError(f"the index at {path} has {known['buckets']} buckets, not {buckets}")
        else:
            self.buckets, self.generation = known["buckets"], known["generation"]
        self.name = self._declared(self.generation)

    def _facts(self):
        try:
            facts = self.spark.read.schema("buckets INT, generation INT").parquet(f"{self.path}/facts")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return facts.orderBy(F.desc("generation")).first()

    def _note(self, generation: int) -> None:
        row = self.spark.range(1).select(
            F.lit(self.buckets).alias("buckets"), F.lit(generation).alias("generation")
        )
        row.write.mode("append").parquet(f"{self.path}/facts")
        self.generation = generation

    def _declared(self, generation: int) -> str:
        """Name of the table over one generation: a digest of its exact folder."""
        folder = f"{self.path}/rows-{generation}"
        name = "digests_" + hashlib.sha256(folder.encode()).hexdigest()[:40]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )
        return name

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unknown(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` that the index lacks; the index is neither shuffled nor, compacted, sorted."""
        return digests.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, name: str, folder: str, mode: str = "append") -> None:
        # One writer task a bucket: each writes one sorted file to its own bucket. The digest goes
        # as an expression of the same value: a plain column would be taken for dealt already
        # when the rows come from a bucketed table, which is then read without its buckets.
        (
            rows.repartition(self.buckets, F.substring("digest", 1, 64))
            .write.mode(mode)
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", folder)
            .saveAsTable(name)
        )

    def add(self, df: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Append the texts of ``df`` that the index lacks; returns the index.

        Of equal texts in the batch the largest key is kept (null keys are the smallest) and
        ``group_size`` counts them; a text that the index holds already stays with the row it has.
        """
        digests = (
            df.select(text_digest(text).alias("digest"), F.col(f"`{key}`").cast("long").alias("key"))
            .groupBy("digest")
            .agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
        )
        with _ordered_scans(self.spark):
            new = self.unknown(digests).withColumn("batch", F.lit(batch))
            self._write(new, self.name, f"{self.path}/rows-{self.generation}")
        return self.rows()

    def compact(self) -> DataFrame:
        """Write the next generation, one sorted file a bucket, and go on with it.

        A reader of an older generation keeps its files; a compaction that was cut short before
        its generation was noted is written anew.
        """
        following = self.generation + 1
        name = self._declared(following)
        self._write(self.rows(), name, f"{self.path}/rows-{following}", "overwrite")
        self._note(following)
        self.name = name
        return self.rows()


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """Open or create the index in the folder ``path``; a fresh folder of the shared one if None.

    ``buckets`` counts for a new index only (default: the session's shuffle partitions); an
    existing one refuses another number.
    """
    return DigestIndex(spark, path or scratch_path(spark, "digest-index"), buckets)


def look_up(df: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    ``kept`` is true for exactly the row whose key the index keeps. Rows with equal key and
    equal text are one document that came repeatedly: all of them are marked as kept if the
    key is, and ``group_size`` counts each. Null keys are kept only where no equal text has
    a key. Columns of these names in ``df`` are replaced.

    The texts of ``df`` must be in the index. No task gathers a hot group.
    """
    own = ("text_sha256", "keep_id", "group_size", "kept")
    df = df.drop(*[c for c in df.columns if c.lower() in own and c not in (key, text)])
    digest = fresh(df, "digest")
    rows = df.withColumn(digest, text_digest(text))
    facts = index.select(F.col("digest").alias(digest), "keep_id", "group_size")
    joined = join_by_group(rows, facts, digest, "group_size")
    return joined.withColumns(
        {"text_sha256": F.col(digest), "kept": F.col(f"`{key}`").cast("long").eqNullSafe(F.col("keep_id"))}
    ).drop(digest)


def deduplicate(df: DataFrame, path: str | None = None, batch: str = "0", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``df`` to the index at ``path`` (a new one if None) and mark its rows.

    An empty table gives an empty table and leaves the index as it is. Empty and null texts
    are one group.
    """
    index = open_index(df.sparkSession, path)
    return look_up(df, index.add(df, batch, key, text), key, text)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY d) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY d) AS kept, d AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents)
"""
