"""Deterministic samples, permutations and group splits ranked by seeded hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.operators.running import numbered, running_totals
from detlake.session import stored


def seeded_rank(seed, value, separator: str = ":") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sha2(F.concat(F.lit(f"{seed}{separator}"), value.cast("string")), 256)


DEFAULT_SEED = "pcb-v1"  # fixed value: assignments depend on it


def grouped_split(
    groups: DataFrame, seed: str = DEFAULT_SEED, share: float = 0.15
) -> DataFrame:
    """Assign whole groups: the first share to test, the next to validation, rest train."""
    distinct = groups.select("group_id").distinct()
    ranked = numbered(
        distinct.withColumn("_h", seeded_rank(seed, "group_id", "\0")),
        [F.col("_h"), F.col("group_id")],
    )
    total = ranked.count()
    if total < 3:
        raise ValueError(f"{total} groups cannot fill three splits")
    held = max(1, round(total * share))
    split = (
        F.when(F.col("number") <= held, "test")
        .when(F.col("number") <= 2 * held, "validation")
        .otherwise("train")
    )
    return ranked.select("group_id", split.alias("split"))


def stratified_sample(
    rows: DataFrame,
    labels: DataFrame,
    classes: list,
    count: int,
    seed,
    per_class: int = 16,
    key: str = "file",
) -> DataFrame:
    """``per_class`` positives of every class by hash rank, then filled up to ``count``.

    Fails when a class has too few positives. ``labels``: key, class.
    """
    if count < per_class * len(classes):
        raise ValueError("count must cover the sample of every class")
    ranked = rows.withColumn("_h", seeded_rank(seed, key))
    positives = labels.select(key, "class").distinct()
    by_class = Window.partitionBy("class").orderBy("_h", key)
    chosen = (
        positives.join(ranked.select(key, "_h"), key)
        .withColumn("_n", F.row_number().over(by_class))
        .filter(F.col("_n") <= per_class)
    )
    reached = {r["class"]: r["n"] for r in chosen.groupBy("class").agg(F.count("*").alias("n")).collect()}
    if any(reached.get(c, 0) < per_class for c in classes):
        raise ValueError(f"coverage: a class has fewer than {per_class} positives")
    core = chosen.select(key).distinct()
    missing = count - core.count()
    fill = (
        ranked.join(core, key, "left_anti").orderBy("_h", key).limit(max(0, missing)).select(key)
    )
    picked = core.union(fill)
    return rows.join(picked, key, "left_semi")


def training_order(
    views: DataFrame,
    seed: int,
    epochs: int | None = None,
    max_steps: int | None = None,
    key: str = "view_id",
    batch: int = 1,
) -> DataFrame:
    """Every view once per pass in a seeded order; a step budget cuts the last pass.

    Returns pass (from 0), step (from 1) and batch number (from 0).
    """
    if (epochs is None) == (max_steps is None):
        raise ValueError("give exactly one of epochs and max_steps")
    size = views.count()
    if size == 0 or (epochs or max_steps) < 1:
        raise ValueError("views and budget must be positive")
    passes = epochs if epochs is not None else -(-max_steps // size)
    repeated = views.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    ).withColumn(
        "_h",
        F.sha2(F.concat((F.col("pass") + seed).cast("string"), F.lit(":"), F.col(key).cast("string")), 256),
    )
    ordered = running_totals(
        repeated, ["pass"], [F.col("_h"), F.col(key)], {"place": F.lit(1).cast("bigint")}
    )
    steps = ordered.select(
        "pass",
        (F.col("pass") * size + F.col("place")).alias("step"),
        F.floor((F.col("place") - 1) / batch).alias("batch"),
        key,
    )
    return steps if max_steps is None else steps.filter(F.col("step") <= max_steps)


def evenly_spaced(rows: DataFrame, order: list[Column], n: int = 12) -> DataFrame:
    """At most ``n`` rows at equal distances in a total order, starting with the first."""
    ranked = numbered(rows, order, "_n")
    step = max(1, ranked.count() // n)
    return (
        ranked.filter(((F.col("_n") - 1) % step == 0) & (F.col("_n") <= step * n)).drop("_n")
    )


def first_per_class(rows: DataFrame, key: str, order: list[str], n: int = 6) -> DataFrame:
    ranked = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= n).drop("_n")


def group_stats(images: DataFrame, annotations: DataFrame, classes: list[int]) -> DataFrame:
    """Per group: number of images and of boxes of each class (columns c<id>)."""
    boxes = annotations.join(images.select("image_id", "group_id"), "image_id")
    counted = boxes.groupBy("group_id").agg(
        *[F.count_if(F.col("category_id") == c).alias(f"c{c}") for c in classes]
    )
    return (
        images.groupBy("group_id")
        .agg(F.count("*").alias("images"))
        .join(counted, "group_id", "left")
        .na.fill(0)
    )


#: Part of everything that a holdout should have.
HOLDOUT_SHARE = 0.15
#: Measures by which halves of a choice are brought together.
CELL_MEASURES = 3


def _choices(ranked: DataFrame, groups: int, places: int, measures: list[str]) -> DataFrame:
    """Every choice of ``places`` groups: their numbers, rising, and the sum of each measure.

    Choices are generated as index tuples i1 < i2 < … and joined to the group statistics
    by index, so the work is spread over tasks.
    """
    rows = ranked.sparkSession.range(1, groups - places + 2).withColumnRenamed("id", "i1")
    for place in range(2, places + 1):
        last = groups - places + place
        rows = rows.withColumn(
            f"i{place}",
            F.explode(F.sequence(F.col(f"i{place - 1}") + 1, F.lit(last).cast("bigint"))),
        )
    for place in range(1, places + 1):
        part = ranked.select(
            F.col("_n").alias(f"i{place}"), *[F.col(m).alias(f"{m}_{place}") for m in measures]
        )
        rows = rows.join(part, f"i{place}")
    sums = [
        sum((F.col(f"{m}_{p}") for p in range(2, places + 1)), F.col(f"{m}_1")).alias(m) for m in measures
    ]
    return rows.select(F.array(*[f"i{p}" for p in range(1, places + 1)]).alias("chosen"), *sums)


class _Holdout:
    """What a choice of groups is judged by."""

    def __init__(self, stats: DataFrame, count: int, totals: DataFrame | None, target: float):
        self.measures = [c for c in stats.columns if c != "group_id"]
        self.ranked = stored(numbered(stats, [F.col("group_id")], "_n"), "holdout-groups")
        self.groups, self.count, self.target = self.ranked.count(), count, target
        if self.groups <= count:
            raise ValueError("too few groups to hold any out")
        sums = [F.sum(c).alias(c) for c in self.measures]
        self.available, self.whole = stats.agg(*sums).first(), (totals or stats).agg(*sums).first()

    def share(self, measure: str, picked: Column) -> Column:
        return picked / F.lit(self.whole[measure])

    def judged(self, choices: DataFrame) -> DataFrame:
        """Choices that leave every class on both sides, with their score."""
        covered = F.lit(True)
        for c in self.measures:
            if c != "images":
                covered = covered & (F.col(c) > 0) & (F.col(c) < self.available[c])
        score = sum(
            (F.pow(self.share(m, F.col(m)) - self.target, F.lit(2)) for m in self.measures), F.lit(0.0)
        )
        return choices.filter(covered).withColumn("score", score)

    def named(self, choices: DataFrame) -> DataFrame:
        """groups, score and tie of choices: the names in the order of their numbers."""
        listed = choices.select("chosen", "score", F.posexplode("chosen").alias("place", "_n"))
        names = listed.join(self.ranked.select("_n", "group_id"), "_n").groupBy("chosen", "score").agg(
            F.array_sort(F.collect_list(F.struct("place", "group_id"))).alias("parts")
        )
        groups = F.array_join("parts.group_id", "|")
        return names.select(groups.alias("groups"), "score", F.sha2(groups, 256).alias("tie"))


def holdout_choices(stats: DataFrame, count: int, totals: DataFrame | None = None,
                    target: float = HOLDOUT_SHARE) -> DataFrame:
    """Every choice of ``count`` groups with its score, best first under (score, tie).

    A choice must leave every class present on both sides. ``totals`` (default: of ``stats``)
    sets the shares that are scored. The list has as many rows as there are choices; see
    ``best_holdouts`` for the best ones alone.
    """
    how = _Holdout(stats, count, totals, target)
    return how.named(how.judged(_choices(how.ranked, how.groups, count, how.measures)))


def best_holdouts(stats: DataFrame, count: int, totals: DataFrame | None = None,
                  target: float = HOLDOUT_SHARE) -> DataFrame:
    """The choices of ``holdout_choices`` with the lowest score, without listing all.

    A choice is its lower-numbered half and the rest. All halves are listed, which are about
    the square root of the choices, and brought together where their shares add up to the target
    within a radius: halves meet in cells of that size. Every choice whose score is the
    radius squared or less is found that way, so the best found is the best there is; if none
    is found the radius grows. Equal scores all come out. No row if no choice keeps every
    class on both sides.
    """
    how = _Holdout(stats, count, totals, target)
    if count == 1:
        found = how.judged(_choices(how.ranked, how.groups, 1, how.measures))
        return how.named(_lowest(found))
    few = count // 2
    low = stored(_choices(how.ranked, how.groups, few, how.measures), "holdout-halves")
    high = stored(_choices(how.ranked, how.groups, count - few, how.measures), "holdout-halves")
    radius = 0.05 * math.comb(how.groups, count) ** (-1 / len(how.measures))
    while True:
        found = stored(_within(how, low, high, radius), "holdout-found")
        if not found.isEmpty() or radius * radius > len(how.measures):
            return how.named(_lowest(found))
        radius *= 2


def _lowest(found: DataFrame) -> DataFrame:
    best = found.agg(F.min("score").alias("score")).first()["score"]
    return found.filter(F.col("score") <= F.lit(best).cast("double"))


def _within(how: _Holdout, low: DataFrame, high: DataFrame, radius: float) -> DataFrame:
    """Choices of two halves whose score is at most ``radius`` squared.

    Cells are eight radii wide, so what a half lacks, give or take the radius, mostly lies in
    one cell and a half is seldom listed twice.
    """
    by = how.measures[:CELL_MEASURES]
    reach, size = F.lit(radius * (1 + 1e-9)), F.lit(8 * radius)
    right = high.select(
        F.col("chosen").alias("others"),
        *[F.col(m).alias(f"more_{m}") for m in how.measures],
        *[F.floor(how.share(m, F.col(m)) / size).alias(f"_{m}") for m in by],
    )
    left = low
    for m in by:
        lacks = how.target - how.share(m, F.col(m))
        cells = F.sequence(F.floor((lacks - reach) / size), F.floor((lacks + reach) / size))
        left = left.withColumn(f"_{m}", F.explode(cells))
    met = left.join(right, [f"_{m}" for m in by]).filter(
        F.element_at("chosen", -1) < F.element_at("others", 1)
    )
    whole = met.select(
        F.concat("chosen", "others").alias("chosen"),
        *[(F.col(m) + F.col(f"more_{m}")).alias(m) for m in how.measures],
    )
    return how.judged(whole).filter(F.col("score") <= radius * radius)


def choose_holdout(stats: DataFrame, count: int, totals: DataFrame | None = None) -> list[str]:
    """The groups whose shares come closest to 15 percent of everything."""
    best = best_holdouts(stats, count, totals).orderBy("score", "tie").limit(1).collect()
    if not best:
        raise ValueError("cannot keep every class on both sides")
    return best[0]["groups"].split("|")


def holdout_split(stats: DataFrame, share: float = 0.15) -> DataFrame:
    """Test groups first, then validation groups from the rest, the others train."""
    count = max(1, round(stats.count() * share))
    test = choose_holdout(stats, count)
    rest = stats.filter(~F.col("group_id").isin(test))
    validation = choose_holdout(rest, count, stats)
    split = (
        F.when(F.col("group_id").isin(test), "test")
        .when(F.col("group_id").isin(validation), "validation")
        .otherwise("train")
    )
    return stats.select("group_id", split.alias("split"))
