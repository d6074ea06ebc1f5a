"""Ranked lexical search by dense blocked matrix products.

Items (queries) come in tiles with the compact vocabulary of their own terms; documents in
tiles of their impacts, one whole number for each term that they hold. The product of an item
tile and a document tile gives all their scores. All entries are whole and the columns of one
product are so few that every partial sum stays below 2^53, so doubles add them exactly in any
order; sums of several products are longs. Each task keeps, for each item, the best documents
with ties in order of their keys, and Spark ranks what the tasks have kept.

Items are taken in batches of at most ``BATCH_BYTES`` of text, so that the vocabulary that
travels to the tasks has a bound; each batch reads the documents once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detlake.llm.common import parts_for, text_bytes, whole_text
from detlake.session import stored

ITEM_TILE = 64
DOCUMENT_TILE = 512
#: Columns of one product; fewer where impacts are so high that sums could reach 2^53.
TERM_TILE = 4096
BATCH_BYTES = 16 << 20
#: Texts are split into terms in parts of about this size, cut between terms.
PART_BYTES = 1 << 20
#: Scores that a task gathers before it drops what cannot be among the best.
HELD = 50_000
EXACT = 2**53
# ASCII characters that are no part of a term, and the weights of the ranking.
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLDED = bytes(b if b >= 128 else ord(chr(b).lower()) if b in _LETTERS else 32 for b in range(256))
_NO_KEY = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, part by part: runs of ASCII letters, digits and all other
    characters above ASCII, with A-Z in lower case."""
    folded = text.translate(_FOLDED)
    low = 0
    while low < len(folded):
        high = folded.find(b" ", low + PART_BYTES)
        high = len(folded) if high < 0 else high
        yield folded[low:high].split()
        low = high


@dataclass
class Items:
    """Items of one batch: ids, the numbers of their distinct terms, and the terms."""

    ids: list[int | None]
    holds: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @staticmethod
    def of(rows: list[tuple[int | None, bytes]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        holds = []
        for _, text in rows:
            own = {t for part in terms(text) for t in part}
            holds.append(np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in own), np.int64))
        return Items([i for i, _ in rows], holds, vocabulary)

    def tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first item, compact vocabulary, items by terms as zeros and ones)."""
        for low in range(0, len(self.holds), ITEM_TILE):
            part = self.holds[low : low + ITEM_TILE]
            known = np.unique(np.concatenate(part))
            dense = np.zeros((len(part), len(known)))
            for i, own in enumerate(part):
                dense[i, np.searchsorted(known, own)] = 1
            yield low, known, dense


def _counts(vocabulary: dict[bytes, int]):
    """Per document with a term: key, n (all its terms) and its counts of known terms, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            at, sizes, found, times = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                n, known = 0, []
                for part in terms(text.as_py()):
                    n += len(part)
                    known += [t for t in map(number, part) if t is not None]
                if n:
                    own, count = np.unique(np.array(known, np.int32), return_counts=True)
                    at.append(i)
                    sizes.append(n)
                    found.append(own.astype("<i4").tobytes())
                    times.append(count.astype("<i4").tobytes())
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.binary()), pa.array(times, pa.binary())], ["key", "n", "terms", "times"])

    return run


def _documents_of_terms(size: int):
    """(term, documents that hold it) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(own, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    return run


def impacts(weights: np.ndarray, terms_: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m of the term's document."""
    return weights[terms_] * (1_000_000_000 * times // (1000 * times + 8 * lengths))


class Best:
    """For each item the ``k`` best (score, key) seen so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, first: int, scores: np.ndarray, keys: np.ndarray) -> None:
        of, at = np.nonzero(scores >= self.least[first : first + len(scores), None])
        self.held.append(np.stack([of + first, scores[of, at], keys[at]]))
        self.size += len(of)
        if self.size > HELD + self.k * len(self.least):
            self.prune()

    def prune(self) -> np.ndarray:
        rows = np.concatenate(self.held, axis=1) if self.held else np.zeros((3, 0), np.int64)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        full = place == self.k - 1
        self.least[rows[0, full]] = rows[1, full]
        rows = rows[:, place < self.k]
        self.held, self.size = [rows], rows.shape[1]
        return rows


def _ranked(items: Items, weights: np.ndarray, documents: int, length: int, k: int):
    """The best documents of each item among those of a task."""
    tiles = list(items.tiles())
    # An impact is below 10^6 times its weight.
    columns = max(1, min(TERM_TILE, (EXACT - 1) // (max(1, int(weights.max(initial=0))) * 1_000_000)))
    ids = pa.array(items.ids, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.array([10 + 90 * n * documents // length for n in batch.column(1).to_pylist()], np.int64)
            own, times = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for low in range(0, len(keys), DOCUMENT_TILE):
                part = slice(low, low + DOCUMENT_TILE)
                found = np.frombuffer(b"".join(own[part]), "<i4")
                of = np.repeat(np.arange(len(own[part])), [len(b) // 4 for b in own[part]])
                count = np.frombuffer(b"".join(times[part]), "<i4").astype(np.int64)
                value = impacts(weights, found, count, lengths[part][of])
                for first, known, dense in tiles:
                    place = np.searchsorted(known, found)
                    here = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == found) if len(known) else []
                    scores = np.zeros((len(dense), len(own[part])), np.int64)
                    for at in range(0, len(known), columns):
                        now = here[(place[here] >= at) & (place[here] < at + columns)]
                        tile = np.zeros((scores.shape[1], min(columns, len(known) - at)))
                        tile[of[now], place[now] - at] = value[now]
                        scores += (dense[:, at : at + columns] @ tile.T).astype(np.int64)
                    best.add(first, scores, keys[part])
        item, score, key = best.prune()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), ids.take(pa.array(item)), pa.array(key), pa.array(score)], ["item", "item_id", "doc_id", "score"]
        )

    return run


def _search(spark: SparkSession, docs: DataFrame, items: Items, k: int) -> DataFrame:
    size = len(items.vocabulary)
    counted = stored(docs.mapInArrow(_counts(items.vocabulary), "key long, n long, terms binary, times binary"), "lexical-counts")
    facts = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(size, np.int64)
    held = counted.select("terms").mapInArrow(_documents_of_terms(size), "term int, df long")
    for row in held.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the batch's terms
        df[row["term"]] = row["df"]
    n = facts["documents"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    some = counted.mapInArrow(
        _ranked(items, weights, n, max(1, facts["length"]), k), "item long, item_id long, doc_id long, score long"
    )
    ordered = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = some.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(_NO_KEY)).alias("doc_id"), "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item.

    Only scores above 0 count; ties go to the smaller key, null keys last. Null texts have no
    terms; neither documents nor items without terms appear. A repeated document counts and
    appears each time, a repeated item (same id and text) is answered once. Empty tables give
    no rows. Very long texts are split into terms part by part. Other columns are not read, so
    their names do not matter.
    """
    spark = docs.sparkSession
    documents = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NO_KEY)).alias("key"),
        F.encode(whole_text(f"`{text}`"), "UTF-8").alias("text"),
    )
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("id"), whole_text(f"`{item_text}`").alias("text")).distinct()
    batches = parts_for(text_bytes(asked), batch_bytes)
    number = F.pmod(F.xxhash64("id", "text"), F.lit(batches))
    out = None
    for b in range(batches):
        rows = asked.filter(number == b).orderBy("id", "text").collect()  # about batch_bytes
        part = _search(spark, documents, Items.of([(r["id"], r["text"].encode()) for r in rows]), k)
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP12_SQL = r"""
WITH words AS (
    SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL
          SELECT DISTINCT 'i', item_id, text FROM benchmark)
), rows AS (
    SELECT row_number() OVER () AS r, kind, id, ws, len(ws) AS n FROM words WHERE len(ws) > 0
), facts AS (
    SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM rows WHERE kind = 'd'
), tf AS (
    SELECT r, id, n, t, count(*) AS tf FROM (SELECT r, id, n, unnest(ws) AS t FROM rows WHERE kind = 'd') GROUP BY ALL
), df AS (
    SELECT t, count(*) AS df FROM tf GROUP BY t
), weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, facts
), impact AS (
    SELECT r, id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))) AS v
    FROM tf JOIN weights USING (t), facts
), asked AS (
    SELECT DISTINCT r AS q, id AS item_id, unnest(ws) AS t FROM rows WHERE kind = 'i'
), scores AS (
    SELECT q, item_id, r, impact.id AS doc_id, CAST(sum(v) AS BIGINT) AS score
    FROM asked JOIN impact USING (t) GROUP BY ALL HAVING sum(v) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores)
WHERE rank <= 10
"""
