"""Token ids in flat binary files that can be mapped into memory.

A data set is a folder of shards in ascending document order. Shard ``n`` is a pair:

* ``n.ids``: the token ids of its documents, one after another, as little-endian unsigned
  integers of 2 or 4 bytes, nothing else;
* ``n.idx``: little-endian 64-bit integers: version, width of an id in bytes, number of
  documents, number of ids before the shard in the whole data set (its base), then the
  offset of every document in the whole data set and one closing offset, then the
  document keys, then one byte for each document that is 1 if its key is null.

``manifest`` (a Parquet table) lists the shards. Bases are prefix sums of the shards'
counts: ids are written first, then the small index files, once all counts are known.

Files are written under a name of the task's own and renamed when complete, so that a
task that runs twice or is lost leaves whole files only; the manifest names the valid
ones. Paths may be local to a shared folder or in any store that Arrow's file systems
open; local files are mapped into memory when read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.llm.common import parts_for, text_bytes, whole_text
from detlake.llm.word_encoder import id_width, word_encoder
from detlake.session import scratch_path, stored

VERSION = 1
HEADER = 4
#: UTF-8 bytes of text in one shard.
SHARD_BYTES = 24 << 20
_SHARDS = "first_key long, first_tie long, shard string, docs long, ids long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a plain path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_ids(folder: str, path: str, end_id: int):
    """Encode the rows of a partition and write one shard; its counts are the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes, keys, out, first_tie = word_encoder(path), [], [], None, 0
        end = np.asarray([end_id], encoder.form).tobytes()
        files, root = open_folder(folder)
        name = uuid.uuid4().hex
        for batch in batches:
            if out is None:
                first_tie = batch.column("tie")[0].as_py()
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}.ids.part")
            keys += batch.column("key").to_pylist()
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py()) + end
                out.write(ids)
                sizes.append(len(ids) // encoder.width)
        if out is None:
            return
        out.close()
        files.move(f"{root}/{name}.ids.part", f"{root}/{name}.ids")
        numbers = [*accumulate(sizes, initial=0), *(k or 0 for k in keys)]
        body = np.asarray(numbers, "<i8").tobytes() + bytes(k is None for k in keys)
        with files.open_output_stream(f"{root}/{name}.local") as local:
            local.write(body)
        yield pa.RecordBatch.from_pylist(
            [{"first_key": keys[0], "first_tie": first_tie, "shard": name, "docs": len(sizes), "ids": sum(sizes)}],
            pa.schema([("first_key", pa.int64()), ("first_tie", pa.int64()), ("shard", pa.string()),
                       ("docs", pa.int64()), ("ids", pa.int64())]),
        )

    return run


def _write_index(folder: str, width: int):
    """Turn a shard's own offsets into offsets of the whole data set, given its base."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for frame in frames:
            for shard, docs, base in frame[["shard", "docs", "base"]].itertuples(index=False):
                with files.open_input_file(f"{root}/{shard}.local") as local:
                    body = local.read()
                offsets = np.frombuffer(body, "<i8", docs + 1) + base
                part = f"{root}/{shard}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(np.asarray([VERSION, width, docs, base], "<i8").tobytes())
                    out.write(offsets.astype("<i8").tobytes())
                    out.write(body[8 * (docs + 1) :])
                files.move(part, f"{root}/{shard}.idx")
            yield frame

    return run


def write_token_files(
    df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the data set into the empty ``folder``; returns its manifest, in shard order.

    Null or empty text gives the end id alone. Null keys come first; rows with equal keys
    stay separate documents in the order of their texts. An empty table gives a manifest
    without rows. Other columns are not kept.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), whole_text(f"`{text}`").alias("text"))
    # The digest splits a key that many rows share; it also settles the order of ties.
    parts = parts_for(text_bytes(rows), SHARD_BYTES)
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "key", "tie")
    shards = stored(
        ranged.sortWithinPartitions("key", "tie", "text").mapInArrow(
            _write_ids(folder, path, end_id), _SHARDS
        ),
        "token-shards",
    )
    # One row a shard of some ``SHARD_BYTES`` of text: prefix sums of these few numbers. Shards are
    # ranges of (key, tie), so their first rows put them in order.
    order = shards.orderBy(F.col("first_key").asc_nulls_first(), "first_tie").collect()
    base, listed = 0, []
    for n, row in enumerate(order):
        listed.append((n, row["shard"], row["docs"], row["ids"], base))
        base += row["ids"]
    schema = "n int, shard string, docs long, ids long, base long"
    width = id_width(word_encoder(path).tokenizer.get_vocab_size())
    manifest = spark.createDataFrame(listed, schema)
    if listed:
        manifest = manifest.repartition(min(len(listed), 200), "shard")
    indexed = manifest.mapInPandas(_write_index(folder, width), schema)
    indexed.write.parquet(f"{folder.rstrip('/')}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest")


def open_shard(folder: str, shard: str):
    """(ids, offsets in the data set, keys, null flags); local ids are mapped, not read."""
    files, root = open_folder(folder)

    def numbers(name: str, kind: str):
        if isinstance(files, fs.LocalFileSystem):
            return np.memmap(f"{root}/{name}", kind, "r")
        with files.open_input_file(f"{root}/{name}") as file:
            return np.frombuffer(file.read(), kind)

    raw = numbers(f"{shard}.idx", np.uint8)
    version, width, docs, _ = np.frombuffer(raw[: 8 * HEADER], "<i8").tolist()
    if version != VERSION:
        raise ValueError(f"{shard}: version {version}")
    at = 8 * HEADER
    offsets = np.frombuffer(raw[at : at + 8 * (docs + 1)], "<i8")
    at += 8 * (docs + 1)
    keys = np.frombuffer(raw[at : at + 8 * docs], "<i8")
    return numbers(f"{shard}.ids", f"<u{width}"), offsets, keys, np.frombuffer(raw[at + 8 * docs :], np.uint8)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["shard"]:
                ids, offsets, keys, null = open_shard(folder, shard)
                base = int(offsets[0])
                crcs = [
                    zlib.crc32(np.asarray(ids[low:high], "<u4").tobytes())
                    for low, high in zip(
                        (offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True
                    )
                ]
                yield pd.DataFrame(
                    {"key": pd.arrays.IntegerArray(keys.copy(), null.astype(bool)),
                     "start": offsets[:-1], "n_tokens": np.diff(offsets),
                     "ids_crc32": np.asarray(crcs, np.int64)}
                )

    schema = "key long, start long, n_tokens long, ids_crc32 long"
    shards = read_manifest(spark, folder).select("n", "shard")
    return shards.repartition("n").select("shard").mapInPandas(run, schema)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder).withColumnRenamed("key", "doc_id")
