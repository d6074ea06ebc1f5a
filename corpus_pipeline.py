"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``: doc_id, text, lang, source, n_chars.

Nulls: a null text counts as empty and is rejected by the quality rules. Extra columns pass
all but the last stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.llm.common import fresh
from detlake.llm.exact_dedup import deduplicate
from detlake.llm.mixing import mix
from detlake.llm.near_join import near_join
from detlake.llm.pieces import piece_report
from detlake.llm.quality import quality_rules
from detlake.session import scratch_path

#: A source is repeated at most this often when sources are mixed.
EPOCHS = 3.0
MODEL = "piece_bpe_32k.model"


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _judged(docs: DataFrame, operator) -> DataFrame:
    """Rows of ``docs`` as one struct column beside what ``operator`` adds to key and text,
    so that columns of ``docs`` keep their names whatever the operator calls its own."""
    row = fresh(docs, "document")
    bare = docs.select("doc_id", "text", "source", F.struct(*_columns(docs)).alias(row))
    return operator(bare).withColumnRenamed(row, "document")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules."""
    return _judged(docs, quality_rules).filter("kept").select("document.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: the largest doc_id, once even if its row comes repeatedly."""
    kept = _judged(docs, deduplicate).filter("kept")
    single = kept.filter("group_size = 1")
    repeated = kept.filter("group_size > 1").groupBy("text_sha256").agg(F.first("document").alias("document"))
    return single.select("document.*").unionByName(repeated.select("document.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least doc_id."""
    return _judged(docs, near_join).filter("kept").select("document.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it does not take go."""
    rows = _judged(docs, lambda d: mix(d, epochs=EPOCHS))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.filter("copies > 0").select("document", times.alias("time")).select("document.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip of every document that is left."""
    import public_tokenizers

    return piece_report(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("mixing sources", mixed),
    ("sentencepiece", encoded),
]

#: Near duplicates, the mix and the encoding cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
