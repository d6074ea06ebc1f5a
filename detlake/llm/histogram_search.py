"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in tiles of both, and no score is kept. Each round
lays ``BINS`` bins over the interval in which a query's kth score must lie, counts the scores
of all tiles in them, and goes on in the bin that holds the kth. The interval ends at one
integer (or earlier, where exactly k scores are at or above it). A last pass takes what is at or
above that score, ties in order of the keys.

A tile reports its bins from the top down to the one of its own kth score: the kth of all is
never below it, so what is left out can't be counted, and a tile's report stays at k bins a
query however many scores are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.llm.common import parts_for
from detlake.llm.vectors import finite, matrix, on_grid
from detlake.session import stored

#: Rows, and queries, of one tile.
TILE = 8192
BINS = 1024
#: Scores of one tile that exist at a time.
SLAB = 2_000_000
_NEVER = np.iinfo(np.int64).min
_NO_KEY = np.iinfo(np.int64).max


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """(row, key, asks, norm, data): packed longs, written once so that row numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), width)
            norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            data = pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(norms), data], ["row", "key", "asks", "norm", "data"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "key", "asks", "x")
    return stored(numbered.mapInArrow(run, "row long, key long, asks boolean, norm double, data binary"), "search-rows")


def _scores(queries: np.ndarray, rows: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products: in doubles if every partial sum is below 2^53, else in longs."""
    if small:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def _slabs(rows: pd.DataFrame, queries: pd.DataFrame, small: bool):
    """(queries, their keys and scores against the tile's rows); a query's own key never counts."""
    if rows.empty or queries.empty:
        return
    x = np.frombuffer(b"".join(rows["data"]), "<i8").reshape(len(rows), -1)
    keys = rows["key"].to_numpy()
    step = max(1, SLAB // len(rows))
    for low in range(0, len(queries), step):
        part = queries.iloc[low : low + step]
        q = np.frombuffer(b"".join(part["data"]), "<i8").reshape(len(part), -1)
        scores = _scores(q, x, small)
        scores[part["key"].to_numpy()[:, None] == keys] = _NEVER
        yield part, keys, scores


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The kth highest score of each query, or its lowest if there are fewer."""
    at = max(0, scores.shape[1] - k)
    return np.partition(scores, at, axis=1)[:, at]


def _counted(k: int, bins: int, small: bool):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, _, scores in _slabs(rows, queries, small):
            low, width = part["low"].to_numpy()[:, None], part["width"].to_numpy()[:, None]
            own = np.maximum(_kth(scores, k)[:, None], low)
            floor = low + (own - low) // width * width
            # The last bins can reach beyond the interval: what is there is above it, and counted.
            of, at = np.nonzero((scores >= floor) & (scores < part["high"].to_numpy()[:, None]))
            place = (scores[of, at] - low[of, 0]) // width[of, 0]
            cells, counts = np.unique(of * bins + place, return_counts=True)
            out.append(pd.DataFrame({"row": part["row"].to_numpy()[cells // bins], "bin": cells % bins, "n": counts}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "bin": [], "n": []})

    return run


def _taken(k: int, small: bool):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, keys, scores in _slabs(rows, queries, small):
            least = np.maximum(part["low"].to_numpy(), _kth(scores, k))
            of, at = np.nonzero((scores >= least[:, None]) & (scores > _NEVER))
            found = scores[of, at]
            order = np.lexsort((keys[at], -found, of))
            of, at, found = of[order], at[order], found[order]
            first = np.searchsorted(of, of)
            kept = np.arange(len(of)) - first < k
            of, at, found = of[kept], at[kept], found[kept]
            out.append(pd.DataFrame({"row": part["row"].to_numpy()[of], "key": keys[at], "score": found}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "key": [], "score": []})

    return run


def top_k_by_histogram(
    df: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024,
    tile: int = TILE, bins: int = BINS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of highest inner product for each row where ``asks``.

    Entries become longs floor(``scale`` * x). Ties go to the smaller key, null keys last. Rows
    that share the query's key are its own and no candidates; a query with fewer than ``k``
    candidates gets all. Null vectors and those with null or non-finite entries take no part;
    shorter vectors count as filled up with zeros. A repeated row is a candidate each time, and is
    asked each time. An empty table, or one without queries, gives no rows. Other columns are not
    read, so their names do not matter. Scores beyond 62 bits are an error.
    """
    column = F.col(f"`{vector}`")
    usable = df.filter(finite(column)).select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NO_KEY)).alias("key"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        on_grid(column, scale).alias("x"),
    )
    width = usable.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()["d"]
    rows = _packed(usable, width)
    size = rows.agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("queries"),
        F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm"),
    ).first()
    bound = size["norm"] ** 2
    if bound >= 2.0**62:
        raise OverflowError("scores exceed 62 bits")
    small = bound < 2.0**53
    blocks, tiles = parts_for(size["rows"], tile), parts_for(size["queries"], tile)
    each = [F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias(n) for n, c in (("tile", tiles), ("block", blocks))]
    left = rows.select("key", "data", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), each[0])
    queries = rows.filter("asks").select(
        *[F.col(c).alias(c) for c in ("row", "key", "norm", "data")],  # columns of their own beside ``left``
        F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"),
    )

    def over_tiles(state: DataFrame, work, schema: str) -> DataFrame:
        right = queries.join(state.select("row", "low", "high", "width"), "row").select("*", each[1])
        return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInPandas(work, schema)

    most = F.ceil(F.col("norm") * F.lit(size["norm"] * (1 + 1e-9))) + 1
    state = queries.select(
        "row", (-most).alias("low"), (most + 1).alias("high"), F.ceil((2 * most + 1) / F.lit(bins)).cast("long").alias("width"),
        F.lit(0).cast("long").alias("above"), F.lit(False).alias("done"),
    )
    downwards = Window.partitionBy("row").orderBy(F.desc("bin"))
    while size["queries"]:
        state = stored(state, "search-state")
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        counts = over_tiles(open_, _counted(k, bins, small), "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        reached = counts.withColumn("sum", F.sum("n").over(downwards)).join(open_.select("row", "above"), "row")
        place = reached.filter(F.col("sum") + F.col("above") >= k).groupBy("row").agg(
            F.max_by(F.struct("bin", "n", "sum"), "bin").alias("at")
        )
        # Where k is not reached, there are fewer candidates: all of them are taken.
        inside = F.col("above") + F.col("at.sum")
        start = F.col("low") + F.coalesce(F.col("at.bin"), F.lit(0)) * F.col("width")
        now = open_.join(place, "row", "left").select(
            "row",
            start.alias("low"),
            F.least("high", start + F.col("width")).alias("high"),
            F.ceil(F.col("width") / F.lit(bins)).cast("long").alias("width"),
            F.when(F.col("at").isNull(), F.col("above")).otherwise(inside - F.col("at.n")).alias("above"),
            (F.col("at").isNull() | (F.col("width") == 1) | (inside == k)).alias("done"),
        )
        state = state.filter("done").unionByName(now)
    ordered = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("key"))
    found = over_tiles(state, _taken(k, small), "row long, key long, score long")
    named = queries.select("row", F.col("key").alias("query_id"))
    return (
        found.withColumn("rank", F.row_number().over(ordered))
        .filter(F.col("rank") <= k)
        .join(named, "row")
        .select("query_id", "rank", F.nullif("key", F.lit(_NO_KEY)).alias("vec_id"), "score")
    )


def op11_histogram_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k_by_histogram(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
