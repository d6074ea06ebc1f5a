"""Fingerprints of decoded images, in Arrow batches; pictures of one size are computed together.

Input is what Spark's image reader yields: BGR bytes, row by row. Grey levels use the
usual luma weights and thumbnails are area averages, so results are deterministic here
but not bit-equal to another library's resize filter.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Luma weights for red, green, blue.
LUMA = (0.299, 0.587, 0.114)

FINGERPRINT = T.StructType(
    [
        T.StructField("dhash", T.LongType()),
        T.StructField("ahash", T.ArrayType(T.LongType())),
        T.StructField("phash", T.ArrayType(T.LongType())),
        T.StructField("mean_luminance", T.DoubleType()),
    ]
)
HEADER = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("frames", T.IntegerType()),
        T.StructField("orientation", T.IntegerType()),
    ]
)


#: Pixels of pictures of one size that are computed together, one picture at least.
STACKED_PIXELS = 1 << 18


def grey_levels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey pictures, stacked, of one size whose bytes follow each other."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, height, width, channels).astype(np.float64)
    if channels == 1:
        return pixels[..., 0]
    red, green, blue = LUMA
    return np.rint(pixels[..., 2] * red + pixels[..., 1] * green + pixels[..., 0] * blue)


class AreaSums:
    """Summed-area tables of a picture or a stack, from which every grid of area averages is read.

    All arithmetic is on whole numbers until the last division: a cell's edges lie at
    multiples of 1/rows and 1/columns of a pixel, so its sum times ``rows * columns`` is whole.
    """

    def __init__(self, grey: np.ndarray):
        *stack, self.height, self.width = grey.shape
        self.table = np.zeros((*stack, self.height + 1, self.width + 1), np.int64)
        np.cumsum(np.cumsum(grey.astype(np.int64), axis=-2), axis=-1, out=self.table[..., 1:, 1:])

    @staticmethod
    def _at(table: np.ndarray, size: int, cells: int) -> np.ndarray:
        """``cells`` times the table's rows at the cell edges, between two rows by parts."""
        whole, part = np.divmod(np.arange(cells + 1) * size, cells)
        after = np.minimum(whole + 1, size)
        part = part[:, None]
        return (cells - part) * table[..., whole, :] + part * table[..., after, :]

    def grid(self, rows: int, columns: int) -> np.ndarray:
        """Area averages in ``rows`` by ``columns`` cells, rounded to whole levels."""
        down = self._at(self.table, self.height, rows)
        across = self._at(down.swapaxes(-1, -2), self.width, columns).swapaxes(-1, -2)
        sums = np.diff(np.diff(across, axis=-2), axis=-1)
        return np.rint(sums / (self.height * self.width))


def _as_long(bits: np.ndarray, order: str) -> np.ndarray:
    """The last 64 bits of each entry as a signed number."""
    packed = np.packbits(bits, axis=-1, bitorder=order)
    return packed.view(">i8" if order == "big" else "<i8")[..., 0].astype(np.int64)


def _row(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid).reshape(*grid.shape[:-2], -1)


def difference_bits(grid: np.ndarray) -> np.ndarray:
    """64 bits of each 8 by 9 grid, most significant first: is a cell brighter than its right neighbour?"""
    return _as_long(_row(grid[..., :-1] > grid[..., 1:]), "big")


def average_bits(grid: np.ndarray) -> np.ndarray:
    """64 bits of each 8 by 8 grid, least significant first: is a cell at least the mean?"""
    return _as_long(_row(grid >= grid.mean(axis=(-2, -1), keepdims=True)), "little")


_BASIS = np.cos((2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 64)


def frequency_bits(grid: np.ndarray) -> np.ndarray:
    """63 bits of each 32 by 32 grid: is a low-frequency cosine coefficient above the median (constant
    term left out)?"""
    values = _row(_BASIS @ grid @ _BASIS.T)[..., 1:]
    above = values > np.median(values, axis=-1, keepdims=True)
    return _as_long(np.concatenate([above, np.zeros_like(above[..., :1])], axis=-1), "little")


def orientations(grid: np.ndarray):
    """A grid and its mirror, each turned by 0, 90, 180 and 270 degrees: the grids of the turned picture."""
    for base in (grid, grid[..., ::-1]):
        for turns in range(4):
            yield np.rot90(base, turns, axes=(-2, -1))


@F.pandas_udf(FINGERPRINT)
def _fingerprints(
    data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series
) -> pd.DataFrame:
    rows: list[tuple] = [(None, None, None, None)] * len(data)
    alike: dict[tuple[int, int, int], list[int]] = {}
    for i, (raw, h, w, c) in enumerate(zip(data, height, width, channels)):
        if raw is not None and h is not None and h > 0:
            alike.setdefault((int(h), int(w), int(c)), []).append(i)
    for (h, w, c), places in alike.items():
        # The largest grid has 32 by 32 cells, however small the picture.
        step = max(1, STACKED_PIXELS // max(h * w, 32 * 32))
        for low in range(0, len(places), step):
            some = places[low : low + step]
            for i, marks in zip(some, _marks(b"".join(data.iloc[i] for i in some), h, w, c), strict=True):
                rows[i] = marks
    out = pd.DataFrame(rows, columns=["dhash", "ahash", "phash", "mean_luminance"], dtype=object)
    # Not by way of doubles, which a null among the numbers would make of them.
    return out.assign(dhash=pd.array(out["dhash"].tolist(), "Int64"), mean_luminance=out["mean_luminance"].astype(float))


def _marks(stacked: bytes, height: int, width: int, channels: int):
    """dhash, ahash, phash and mean luminance of each of some pictures of one size."""
    sums = AreaSums(grey_levels(stacked, height, width, channels))
    large = sums.grid(32, 32)
    return zip(
        difference_bits(sums.grid(8, 9)).tolist(),
        np.stack([average_bits(g) for g in orientations(sums.grid(8, 8))], axis=-1).tolist(),
        np.stack([frequency_bits(g) for g in orientations(large)], axis=-1).tolist(),
        [round(m, 2) for m in large.mean(axis=(-2, -1)).tolist()],
    )


@F.pandas_udf(T.BinaryType())
def three_channels(pixels: pd.Series, channels: pd.Series) -> pd.Series:
    """Grey pixels three times each, pixels with an opacity without it, others as they are."""

    def plain(raw, c):
        if raw is None or c is None or c == 3:
            return raw
        each = np.frombuffer(raw, np.uint8).reshape(-1, int(c))
        return (np.repeat(each, 3, axis=1) if c == 1 else np.ascontiguousarray(each[:, :3])).tobytes()

    return pd.Series([plain(raw, c) for raw, c in zip(pixels, channels)], dtype=object)


def pixel_digest(width="width", height="height", pixels="pixels", channels="channels") -> Column:
    """Digest of the decoded pixels, as three channels, together with the dimensions."""
    prefix = F.concat(F.col(width).cast("string"), F.lit("x"), F.col(height).cast("string"), F.lit(":"))
    return F.sha2(F.concat(F.encode(prefix, "UTF-8"), three_channels(pixels, channels)), 256)


def fingerprints(decoded: DataFrame) -> DataFrame:
    """Fingerprint table of decoded images; unreadable ones keep NULL fingerprints."""
    readable = F.col("height") > 0
    marks = _fingerprints("pixels", "height", "width", "channels")
    return (
        decoded.withColumn("marks", marks)
        .withColumn("pixel_sha256", F.when(readable, pixel_digest()))
        .select("path", "width", "height", "pixel_sha256", "marks.*")
    )


SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _jpeg_size(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        # Frame headers; the three others of this range are tables.
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the headers of PNG and JPEG files; null for what is neither."""
    rows = []
    for raw in content:
        found = None
        if raw is not None and raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR" and len(raw) >= 24:
            found = struct.unpack(">II", raw[16:24])
        elif raw is not None and raw[:3] == b"\xff\xd8\xff":
            found = _jpeg_size(raw)
        rows.append(found or (None, None))
    return pd.DataFrame(rows, columns=["width", "height"]).astype("Int32")


def _jpeg_orientation(raw: bytes) -> int:
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            return _exif_orientation(body[6:])
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def _exif_orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        start = struct.unpack(order + "I", tiff[4:8])[0]
        entries = struct.unpack(order + "H", tiff[start : start + 2])[0]
        for i in range(entries):
            entry = tiff[start + 2 + 12 * i : start + 14 + 12 * i]
            if struct.unpack(order + "H", entry[:2])[0] == 274:
                return struct.unpack(order + "H", entry[8:10])[0]
    except struct.error:
        pass
    return 1


def _png_facts(raw: bytes) -> tuple[int, int]:
    frames, orientation, at = 1, 1, 8
    while at + 8 <= len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if kind == b"acTL":
            frames = int.from_bytes(raw[at + 8 : at + 12], "big")
        elif kind == b"eXIf":
            orientation = _exif_orientation(raw[at + 8 : at + 8 + size])
        elif kind == b"IDAT":
            break
        at += 12 + size
    return frames, orientation


@F.pandas_udf(HEADER)
def image_header(content: pd.Series) -> pd.DataFrame:
    """Format, frame count and orientation from the leading bytes of each file."""
    rows = []
    for raw in content:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            frames, orientation = _png_facts(raw)
            rows.append(("PNG", frames, orientation))
        elif raw[:3] == b"\xff\xd8\xff":
            rows.append(("JPEG", 1, _jpeg_orientation(raw)))
        else:
            rows.append((None, 1, 1))
    return pd.DataFrame(rows, columns=["format", "frames", "orientation"])


def admission_issues(files: DataFrame, decoded: DataFrame, max_pixels: int = 20_000_000) -> DataFrame:
    """Files that may not enter a dataset, with the reason."""
    headers = files.withColumn("h", image_header("content")).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), "h.*"
    )
    sizes = decoded.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), "width", "height"
    )
    reason = (
        F.when(F.col("format").isNull(), "unsupported_format")
        .when(F.col("height").isNull() | (F.col("height") <= 0), "undecodable")
        .when(F.col("width").cast("bigint") * F.col("height") > max_pixels, "too_many_pixels")
        .when(F.col("frames") != 1, "animated")
        .when(F.col("orientation") != 1, "oriented")
    )
    return (
        headers.join(sizes, "path", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("path", F.lit("image_unreadable").alias("code"), "reason")
    )
