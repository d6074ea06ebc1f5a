"""Mixing sources to target weights by capped water-filling.

Each source's share of the whole follows its weight, but no source is repeated more than
``epochs`` times: sources above that cap are clamped, and what they leave is shared again
by weight until none is above. With level ``a`` this is min(epochs * size, a * weight).

A source's documents then get whole repetitions and, in a seeded order of the documents,
one more for as many words as the fraction asks for. Long documents are settled first and
short ones make up for the words that the last long document left or took too much. Each
order is cut into ``PARTS`` slices by the seeded hash; the words of slices are added up
first, so that only the one slice in which a source's fraction ends is put in order, and
no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detlake.llm.common import whole_text, word_count
from detlake.operators.running import numbered
from detlake.session import stored

EPOCHS = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20_240_229
PARTS = 4096
#: Documents of more words count as long.
SHORT_WORDS = 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights go round by code point of the source, a null source last. Only one row of sums
    a round reaches the driver; the level rises each round until no further source is clamped.
    """
    turns = F.array(*[F.lit(float(w)) for w in weights])
    # Sources may be as many as sites: they are numbered by ranges, not in one task.
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    place = ((F.col("place") - 1) % len(weights)).cast("int")
    rated = stored(
        placed.withColumn("weight", F.get(turns, place))
        .drop("place")
        .withColumn("cap", F.lit(float(epochs)) * F.col("source_size")),
        "mix-sources",
    )
    level, clamped = 0.0, -1
    while True:
        below = F.col("cap") <= F.lit(level) * F.col("weight")
        row = rated.agg(
            F.sum("source_size").cast("double").alias("all"),
            F.sum(F.when(below, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(below, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(below, 1)).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or not row["open"]:
            break
        clamped, level = row["clamped"], (row["all"] - row["held"]) / row["open"]
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return rated.select("source", "source_size", target.alias("target"))


def _slice_plan(slices: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each slice of (source, long): ``extra`` 1 or 0, or null where the fraction ends in it.

    ``wanted``: (source, long, wanted, ...), the words to be taken once more; the columns
    behind these are passed on.
    """
    ahead = Window.partitionBy("source", "long").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    wanted = wanted.withColumnsRenamed({"source": "s", "long": "l"})
    ends = F.col("before") + F.col("words")
    return (
        placed.join(wanted, F.col("source").eqNullSafe(F.col("s")) & (F.col("long") == F.col("l")))
        .drop("s", "l")
        .withColumn(
            "extra",
            F.when(ends <= F.col("wanted"), 1).when(F.col("before") > F.col("wanted"), 0),
        )
    )


def _repeated(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` of ``_sized`` with ``extra`` settled, by slice or in order within a slice."""
    plan = plan.select(F.struct(*plan.columns).alias("p"))
    joined = rows.join(
        plan,
        F.col("mix.source").eqNullSafe(F.col("p.source"))
        & (F.col("mix.long") == F.col("p.long"))
        & (F.col("mix.part") == F.col("p.part")),
    )
    ahead = (
        Window.partitionBy("mix.source", "mix.long", "mix.part")
        .orderBy("mix.order", "mix.size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    middle = F.col("p.before") + F.coalesce(F.sum("mix.size").over(ahead), F.lit(0)) + F.col("mix.size") / 2
    edge = joined.filter(F.col("p.extra").isNull())
    return (
        joined.filter(F.col("p.extra").isNotNull())
        .withColumn("extra", F.col("p.extra"))
        .unionByName(edge.withColumn("extra", F.when(middle <= F.col("p.wanted"), 1).otherwise(0)))
    )


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    epochs: float = EPOCHS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` is how often the mix takes the row and ``taken`` the words that makes. The
    words taken of a source miss its target by half of a short document, where it has
    enough short ones, and by half of its longest document at most. Null or empty text has
    size 0; a null source is a source of its own. Repeated rows are separate documents and
    may differ in ``copies`` by one. Columns of these names in ``df`` are replaced; an
    empty table gives an empty table.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    rest = [c for c in df.columns if c.lower() not in own or c in (key, text, source)]
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
        F.col(f"`{source}`").cast("string").alias("source"),
        hashed.alias("order"),
        word_count(whole_text(f"`{text}`")).alias("size"),
    ).select(
        "row",
        F.struct(
            "source", "order", "size", (F.col("size") > SHORT_WORDS).alias("long"),
            F.pmod("order", F.lit(PARTS)).cast("int").alias("part"),
        ).alias("mix"),
    )
    # The words of all texts are counted once for the plan, and once more with the rows at the end.
    sizes = stored(rows.select("mix"), "mix-sizes")
    slices = stored(
        sizes.groupBy("mix.source", "mix.long", "mix.part").agg(F.sum("mix.size").alias("words")),
        "mix-slices",
    )
    targets = source_targets(
        slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("fraction"),
    )
    wanted = stored(
        slices.groupBy("source", "long")
        .agg(F.sum("words").alias("words"))
        .join(rates, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("wanted", F.col("fraction") * F.col("words"))
        .drop("s", "fraction", "words"),
        "mix-wanted",
    )
    # The long documents, and what they leave for the short ones to make up for.
    long_plan = _slice_plan(slices.filter("long"), wanted)
    at_edge = _repeated(sizes.filter("mix.long"), long_plan.filter(F.col("extra").isNull()))
    taken = (
        long_plan.select("source", (F.col("extra") * F.col("words")).alias("words"))
        .unionByName(at_edge.select("p.source", (F.col("extra") * F.col("mix.size")).alias("words")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.sum("words").alias("words"))
    )
    left = (
        wanted.filter("long")
        .join(taken, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), (F.col("wanted") - F.col("words")).alias("left"))
    )
    left = stored(left, "mix-left")
    more = (
        wanted.join(left, F.col("source").eqNullSafe(F.col("s")) & ~F.col("long"), "left")
        .withColumn("wanted", F.col("wanted") + F.coalesce("left", F.lit(0.0)))
        .drop("s", "left")
    )
    copies = F.col("p.whole") + F.col("extra")
    return _repeated(rows, _slice_plan(slices, more)).select(
        "row.*",
        F.col("mix.size").alias("size"),
        F.col("p.source_size").alias("source_size"),
        F.col("p.target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("mix.size")).alias("taken"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
