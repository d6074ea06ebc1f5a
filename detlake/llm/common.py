"""What the operators of this subpackage share: text access, sizes, folders."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that ends a word.
WHITE = r"[\x20\x09-\x0D]"


def whole_text(column: str = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, one row to the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def parts_for(size: int, each: int, least: int = 1) -> int:
    """Number of parts of about ``each`` bytes for ``size`` bytes."""
    return max(least, math.ceil(size / each))


def give_back() -> None:
    """Free memory goes back to the system: a worker lives on between stages, and what it holds
    counts on its executor. Without glibc only Arrow's pool is emptied."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A group is hot if it holds more than this share of all rows; so there are at most its inverse.
HOT_SHARE = 1 / 256


def join_by_group(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row a group of ``size`` rows, on ``key``.

    Groups above ``HOT_SHARE`` of all rows, of which there can be 256 at most, are joined by
    broadcast, so that no task gathers a hot group; all others by an ordinary join. ``key``
    must not be null.
    """
    least = facts.agg((F.coalesce(F.sum(size), F.lit(0)) * HOT_SHARE).alias("n")).first()["n"]
    hot = F.col(size) > max(least, 1)
    few = facts.filter(hot)
    rare = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.filter(~hot), key)
    return rows.join(F.broadcast(few), key).unionByName(rare)


def with_computed(
    df: DataFrame, column: str, kinds: dict[str, str], start: Callable, keep: bool = False
) -> DataFrame:
    """``df`` with the columns ``kinds`` (name to SQL type) computed by Python from ``column``.

    ``start()`` runs once a task and gives a function from an Arrow array of values to one
    list for each new column. All other columns travel as one struct, whatever their names
    and types; those named like a new one (case ignored) are replaced. ``column`` itself is
    dropped unless ``keep``.
    """
    names = list(kinds)
    taken = {n.lower() for n in names}
    rest = [c for c in df.columns if c.lower() not in taken and (keep or c != column)]
    packed = df.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)]).alias("row"),
        F.col(f"`{column}`").alias("value"),
    )
    new = df.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items())).schema
    schema = T.StructType([packed.schema["row"], *new.fields])
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(batch.column(1))
            arrays = [pa.array(v, arrow[kinds[n]]) for n, v in zip(names, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", *names])

    return packed.mapInArrow(run, schema).select(
        *[F.col(f"row._{i}").alias(c) for i, c in enumerate(rest)], *names
    )
