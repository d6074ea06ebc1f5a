"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded where it is read. A longer one is
cut into chunks that overlap by ``overlap`` characters, each encoded with offsets by any
task. Neighbouring chunks are spliced at a proven stable common boundary: a position in
their overlap where both encodings end a token and the text has ASCII white space, across
which the tokenizer neither merges nor normalises. Where an overlap holds no such
position, it is doubled for that text and its chunks are encoded again, until the first
chunk covers the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.common import fresh, whole_text, with_computed
from detlake.llm.word_encoder import word_encoder
from detlake.session import stored

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
WHITE = " \t\n\x0b\x0c\r"

_CHUNKS = "key string, k int, chunks int, begin long, next long, piece string"
_MARKS = "key string, k int, chunks int, n long, head map<long,long>, tail map<long,long>"


def _counter(path: str):
    def start():
        encoder = word_encoder(path)
        return lambda texts: [[len(encoder.encode(t.as_py())) // encoder.width for t in texts]]

    return start


def _cut(chunk_chars: int):
    """Rows of one text: chunk k covers [begin, next) and the overlap behind it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text, overlap in frame[["key", "text", "overlap"]].itertuples(index=False):
                starts = [0] if overlap >= len(text) else list(range(0, len(text), chunk_chars))
                ends = [*starts[1:], len(text)]
                for k, (begin, end) in enumerate(zip(starts, ends, strict=True)):
                    piece = text[begin : min(end + overlap, len(text))]
                    yield pd.DataFrame([(key, k, len(starts), begin, end, piece)]).set_axis(
                        ["key", "k", "chunks", "begin", "next", "piece"], axis=1
                    )

    return run


def stable_boundaries(text: str, ends: list[int], low: int, high: int) -> dict[int, int]:
    """Positions in [low, high) with white space where a token ends, and the tokens before each.

    ``ends`` are token end offsets; a white-space position inside no token is where the
    last token before it has ended, so the count of ends up to it is the count of tokens.
    """
    found, done = {}, 0
    for at in range(max(low, 1), min(high, len(text))):
        if text[at] in WHITE and text[at - 1] not in WHITE:
            while done < len(ends) and ends[done] <= at:
                done += 1
            if done and ends[done - 1] == at:
                found[at] = done
    return found


def _marked(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_encoder(path).tokenizer
        for frame in frames:
            rows = []
            for key, k, chunks, begin, after, piece in frame.itertuples(index=False):
                ends = [e for _, e in tokenizer.encode(piece, add_special_tokens=False).offsets]
                size = after - begin
                # The head reaches as far as the overlap of the chunk before may.
                head = stable_boundaries(piece, ends, 0, len(piece)) if k else {}
                tail = stable_boundaries(piece, ends, size, len(piece)) if k + 1 < chunks else {}
                rows.append(
                    (key, k, chunks, len(ends),
                     {begin + p: c for p, c in head.items()}, {begin + p: c for p, c in tail.items()})
                )
            yield pd.DataFrame(rows, columns=["key", "k", "chunks", "n", "head", "tail"])

    return run


def _spliced(marks: DataFrame) -> DataFrame:
    """(key, n_tokens): null where two neighbouring chunks share no boundary."""
    after = marks.select("key", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
    pairs = marks.join(after, ["key", "k"], "left").withColumn(
        "at", F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("next_head")))
    )
    # Chunk k gives its tokens up to ``at`` but not those before the splice with chunk k-1,
    # which are the tokens that chunk k has before that splice.
    last = F.col("k") + 1 == F.col("chunks")
    gives = F.when(last, F.col("n")).otherwise(
        F.element_at("tail", F.col("at")) - F.element_at("next_head", F.col("at"))
    )
    return pairs.groupBy("key").agg(
        F.when(F.count(gives) == F.count("*"), F.sum(gives)).alias("n_tokens")
    )


def count_huge(texts: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of distinct texts (key, text), widening overlaps as needed."""
    done: DataFrame | None = None
    open_texts = texts
    while True:
        chunks = open_texts.withColumn("overlap", F.lit(overlap)).mapInPandas(_cut(chunk_chars), _CHUNKS)
        marks = stored(
            chunks.repartition("key", "k").mapInPandas(_marked(path), _MARKS), "token-marks"
        )
        counts = _spliced(marks)
        found = counts.filter(F.col("n_tokens").isNotNull())
        done = found if done is None else done.unionByName(found)
        failed = stored(counts.filter(F.col("n_tokens").isNull()).select("key"), "token-failed")
        if failed.isEmpty():
            return done
        open_texts = open_texts.join(failed, "key", "left_semi")
        overlap *= 2


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    out: str = "n_tokens",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``df`` without ``text`` and with ``out``, the tokens of each whole text.

    Null and empty texts have 0 tokens. Equal huge texts are encoded once; repeated rows
    and null or repeated keys elsewhere in the row do not matter, since rows are matched by
    the digest of their text. A column that is named like ``out`` is replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != text])
    df = df.withColumn(text, whole_text(f"`{text}`"))
    key = fresh(df, "text_key")
    rest = [c for c in df.columns if c != text]
    huge = F.length(F.col(f"`{text}`")) > chunk_chars
    small = with_computed(df.filter(~huge), text, {out: "long"}, _counter(path))
    large = df.filter(huge).withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    texts = large.groupBy(F.col(key).alias("key")).agg(F.first(F.col(f"`{text}`")).alias("text"))
    counts = count_huge(texts, path, chunk_chars, overlap).withColumnRenamed("key", key).select(
        key, F.col("n_tokens").alias(out)
    )
    matched = large.drop(text).join(counts, key).select(*[F.col(f"`{c}`") for c in rest], out)
    return small.unionByName(matched)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
