"""Digests of files, tables and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_digest(content="content") -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def row_digest(columns: list[str]) -> Column:
    """Digest of a row; columns enter by name, so their order in the table is irrelevant."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One row: (rows, digest) of a table, whatever its row order or partitioning.

    Equal rows are counted first, so a repeated row cannot crowd one group. Digests are
    then reduced by prefix over two levels (16^5 prefixes, then 16^2, then one), so no
    task gathers more than its share of the table. Row digests travel once, as bytes dealt
    by their first two, which all groups down to 16^5 prefixes have in common.
    """
    placed = df.select(F.unhex(row_digest(df.columns)).alias("b")).withColumn("p", F.substring("b", 1, 2))
    level = (
        placed.repartition("p")
        .groupBy("p", "b")
        .agg(F.count("*").alias("n"))
        .select("p", F.concat(F.lower(F.hex("b")), F.lit(":"), F.col("n").cast("string")).alias("d"), "n")
    )
    for length, keys in ((8, ["p"]), (5, ["p"]), (2, [])):
        level = (
            level.groupBy(*keys, F.substring("d", 1, length).alias("q"))
            .agg(F.array_sort(F.collect_list("d")).alias("ds"), F.sum("n").alias("n"))
            .select(*keys, F.concat("q", F.sha2(F.array_join("ds", ","), 256)).alias("d"), "n")
        )
    return level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("digest"),
    )


def table_sums(df: DataFrame) -> DataFrame:
    """One row by which two tables are compared: their rows and the sums of the four words of the
    row digests. Rows are only summed, so nothing is shuffled; unlike ``table_digest`` it tells
    changes, not forgeries.
    """
    words = df.select(row_digest(df.columns).alias("d")).select(
        *[F.conv(F.substring("d", 1 + 16 * i, 16), 16, 10).cast("decimal(20, 0)").alias(f"w{i}") for i in range(4)]
    )
    return words.agg(F.count("*").alias("rows"), *[F.sum(w).alias(w) for w in words.columns])
