"""Near-duplicate signatures within a Hamming distance, without comparing all pairs.

Both searches are lossless. Equal signatures are collapsed first, so a large group of
copies is one row in the join, however many images share it.

* Small distances: the signature is cut into ``k + extra`` bands. Two signatures within
  distance ``k`` agree on at least ``extra`` bands, so they meet under some combination
  of ``extra`` bands. Key width grows with the table, which keeps key groups small.
* Larger distances: two bands at once. With ``k // 2 + 1`` bands or more, two signatures within
  ``k`` differ by one bit at most in each of some two bands (or, if no bit is to spare, are equal
  in one and differ by exactly two in all others). Keys of two bands are long enough to keep
  their groups small, and each side flips one bit of one of the bands, so a row has hundreds
  of keys where probing long bands to a radius of four takes thousands.
* With a given number of bands: each band is probed to a small radius (pigeonhole per band).
* Where keys would bring a good part of all pairs together anyhow (few bits, or a large distance),
  or the table is so small that its keys cost more than its pairs: tiles. Blocks of signatures
  are compared with each other in numpy, every pair once; tiles are alike in work and in size.

A pair that meets under several keys is kept only under its first one.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.operators.running import running_totals
from detlake.session import stored

COMBINATION_LIMIT = 4  # largest distance searched by band combinations
TILE = 4_096  # signatures of one side of a tile
TASKS = 2_000  # tasks that share the tiles at most
SLAB = 262_144  # pairs of a tile compared at a time
KEYED = 2_000_000  # keys that a task makes of its signatures
# Rough cost of a key and of a candidate met under one, in pairs of a tile.
KEY_COST, CANDIDATE_COST = 1_000, 30


def band_edges(width: int, bands: int) -> list[tuple[int, int]]:
    """(offset, size) of each band, sizes as equal as possible."""
    size, wide = divmod(width, bands)
    edges, offset = [], 0
    for i in range(bands):
        edges.append((offset, size + (i < wide)))
        offset += edges[-1][1]
    return edges


def _as_signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _mask(offset: int, size: int) -> int:
    return _as_signed(((1 << size) - 1) << offset)


def _part(signature: Column, offset: int, size: int) -> Column:
    return F.shiftrightunsigned(signature.bitwiseAND(F.lit(_mask(offset, size))), offset)


def plan_bands(width: int, k: int, rows: int) -> tuple[str, int]:
    """Pick the search and its number of bands from the number of distinct signatures.

    Band combinations aim at keys of about log2(rows) bits: wider keys mean more copies of each row,
    narrower keys mean more candidates per key.
    """
    bits = max(8, min(40, math.ceil(math.log2(max(rows, 2)))))
    if k <= COMBINATION_LIMIT:
        for extra in range(1, 5):
            bands = k + extra
            if extra * (width // bands) >= bits:
                return "combinations", bands
        return "combinations", k + 4
    return "pairs", (k + 1) // 2 + 1


def _combination_keys(signature: Column, width: int, k: int, bands: int) -> Column:
    """Key structs: combination number, its bits, its bands and all bands up to its last."""
    edges = band_edges(width, bands)
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(bands), bands - k)):
        mask = sum(((1 << edges[band][1]) - 1) << edges[band][0] for band in chosen)
        keys.append(
            F.struct(
                F.lit(number).alias("n"),
                signature.bitwiseAND(F.lit(_as_signed(mask))).alias("v"),
                F.lit(sum(1 << band for band in chosen)).alias("bands"),
                F.lit((1 << (chosen[-1] + 1)) - 1).alias("upto"),
            )
        )
    return F.array(*keys)


def _first_combination(difference: Column, width: int, k: int, bands: int) -> Column:
    """Is this the first combination that agrees: are its bands the first agreeing ones?"""
    agreeing = F.lit(0)
    for band, edge in enumerate(band_edges(width, bands)):
        agreeing = agreeing + F.when(_part(difference, *edge) == 0, 1 << band).otherwise(0)
    return agreeing.bitwiseAND(F.col("upto")) == F.col("bands")


def _radii(k: int, bands: int) -> list[int]:
    """Radius per band: the pigeonhole lets later bands use one less."""
    radius, spare = divmod(k, bands)
    return [radius if i <= spare else radius - 1 for i in range(bands)]


def _flips(size: int, radius: int) -> list[int]:
    return [
        sum(1 << b for b in chosen)
        for r in range(radius + 1)
        for chosen in itertools.combinations(range(size), r)
    ]


def _flipped(number: int, part: Column, flips: Column) -> Column:
    return F.transform(
        flips, lambda f: F.struct(F.lit(number).alias("n"), part.bitwiseXOR(f).alias("v"))
    )


def _probe_keys(signature: Column, width: int, k: int, bands: int, spread: bool) -> Column:
    keys = []
    for number, ((offset, size), radius) in enumerate(
        zip(band_edges(width, bands), _radii(k, bands))
    ):
        if radius < 0:
            continue
        flips = F.array(*[F.lit(v).cast("bigint") for v in _flips(size, radius if spread else 0)])
        keys.append(_flipped(number, _part(signature, offset, size), flips))
    return F.flatten(F.array(*keys))


def _first_probe(difference: Column, width: int, k: int, bands: int) -> Column:
    first = F.lit(None).cast("int")
    radii = _radii(k, bands)
    edges = band_edges(width, bands)
    for number in reversed(range(bands)):
        if radii[number] < 0:
            continue
        near = F.bit_count(_part(difference, *edges[number])) <= radii[number]
        first = F.when(near, F.lit(number)).otherwise(first)
    return first == F.col("n")


def _single_bits(size: int) -> Column:
    return F.array(*[F.lit(1 << b).cast("bigint") for b in range(size)])


def _pair_keys(signature: Column, width: int, k: int, bands: int, spread: bool) -> Column:
    """Key structs: bands i < j, their bits, and the bit flipped. One side (``spread``) flips
    in band i, the other in band j, so the same two bands meet once whatever differs.

    Where ``2 * (bands - 1) == k`` there is also the band i that is equal, with the next band
    flipped by one bit on both sides (i is negative then, to keep these keys apart).
    """
    edges = band_edges(width, bands)
    parts = [_part(signature, *e) for e in edges]
    zero = F.array(F.lit(0).cast("bigint"))

    def keyed(number: int, i: int, j: int, flipped: int, flips: Column) -> Column:
        def key(flip: Column) -> Column:
            first, second = (parts[n].bitwiseXOR(flip) if n == flipped else parts[n] for n in (i, j))
            joined = F.shiftleft(first, edges[j][1]).bitwiseOR(second)
            return F.struct(F.lit(number).alias("i"), F.lit(j).alias("j"), joined.alias("v"), flip.alias("flip"))

        return F.transform(flips, key)

    keys = []
    for i, j in itertools.combinations(range(bands), 2):
        flipped = i if spread else j
        keys.append(keyed(i, i, j, flipped, F.concat(zero, _single_bits(edges[flipped][1]))))
    if 2 * (bands - 1) == k:
        for i in range(bands):
            j = (i + 1) % bands
            keys.append(keyed(-1 - i, i, j, j, _single_bits(edges[j][1])))
    return F.flatten(F.array(*keys))


def _first_pair(difference: Column, width: int, k: int, bands: int) -> Column:
    """Is this key the one to report the pair under: the first two bands that differ by at most a
    bit; or, where only one band does, that band, with the lower of the next one's two bits flipped."""
    edges = band_edges(width, bands)
    parts = [_part(difference, *e) for e in edges]
    close = F.filter(F.array(*[F.when(F.bit_count(p) <= 1, F.lit(n)) for n, p in enumerate(parts)]), F.isnotnull)
    two = (F.get(close, F.lit(0)) == F.col("i")) & (F.get(close, F.lit(1)) == F.col("j"))
    following = F.element_at(F.array(*parts), F.col("j") + 1)
    lower = following.bitwiseAND(-following)
    one = (F.size(close) == 1) & (F.col("i") < 0) & (F.col("flip") == lower)
    return F.coalesce(two, F.lit(False)) | one


def _met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both sides that share a key. Spark knows the rows of a side before each becomes its
    hundreds of keys, and would broadcast what looks small through the driver: hence a merge."""
    return a.join(b.hint("merge"), on)


def pair_candidates(a: DataFrame, b: DataFrame, width: int, k: int, bands: int) -> DataFrame:
    """(a, b, i, j, flip) of signatures that meet under keys of two bands, before verification."""
    left = a.select("a", F.inline(_pair_keys(F.col("a"), width, k, bands, True)))
    right = b.select("b", F.inline(_pair_keys(F.col("b"), width, k, bands, False))).drop("flip")
    return _met(left, right, ["i", "j", "v"])


def _keys_per_row(width: int, k: int, search: str, bands: int) -> tuple[int, int]:
    """Keys of a signature, and the bits of the shortest."""
    size = width // bands
    if search == "combinations":
        return math.comb(bands, k), size * (bands - k)
    if search == "probes":
        probed = [(s, r) for (_, s), r in zip(band_edges(width, bands), _radii(k, bands)) if r >= 0]
        return sum(len(_flips(*band)) for band in probed), size
    return math.comb(bands, 2) * (size + 2), 2 * size


def _dealt(df: DataFrame, rows: int, keys: int) -> DataFrame:
    """Signatures in tasks of about ``KEYED`` keys; few bytes as they are, they would share a task or two."""
    return df.repartition(max(1, math.ceil(rows * keys / KEYED)), df.columns[0])


def tiles_are_cheaper(width: int, k: int, left: int, right: int) -> bool:
    """Whether all pairs of ``left`` and ``right`` rows cost less than keys and their candidates."""
    keys, bits = _keys_per_row(width, k, *plan_bands(width, k, right))
    pairs = left * right
    return pairs <= KEY_COST * keys * (left + right) + CANDIDATE_COST * keys * pairs / 2**bits


def _compared(k: int, same: bool):
    """The near pairs of a tile; of one table (``same``) each unordered pair once, the smaller first."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        if len(left) and len(right):
            a, b = (np.asarray(df["block"].iloc[0], np.int64) for df in (left, right))
            inner = same and left["i"].iloc[0] == left["j"].iloc[0]
            step = max(1, SLAB // len(b))
            # Written over by every slab: new arrays take twice the time.
            differ, counts, near = (np.empty((step, len(b)), t) for t in (np.uint64, np.uint8, bool))
            for low in range(0, len(a), step):
                part = a[low : low + step]
                size = len(part)
                np.bitwise_xor(part.view(np.uint64)[:, None], b.view(np.uint64), out=differ[:size])
                np.bitwise_count(differ[:size], out=counts[:size])
                np.less_equal(counts[:size], k, out=near[:size])
                of, at = np.nonzero(near[:size])
                x, y, d = part[of], b[at], counts[of, at].astype(np.int32)
                if inner:
                    once = x <= y
                    x, y, d = x[once], y[once], d[once]
                elif same:
                    x, y = np.minimum(x, y), np.maximum(x, y)
                out.append((x, y, d))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("a", "b", "distance"), zip(*out))})

    return run


def _by_tiles(a: DataFrame, b: DataFrame, k: int, left: int, right: int, same: bool = False) -> DataFrame:
    """(a, b, distance) of all signatures within ``k``: blocks of one side against blocks of the other."""
    mine, others = (max(1, math.ceil(n / TILE)) for n in (left, right))
    tasks = min(TASKS, mine * others)

    def tiled(df: DataFrame, own: str, blocks: int, other: str, numbers) -> DataFrame:
        place = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias(own)
        packed = df.toDF("s").groupBy(place).agg(F.collect_list("s").alias("block"))
        tiles = packed.select("block", own, F.explode(numbers(F.col(own))).alias(other))
        return tiles.repartition(tasks, "i", "j").groupBy("i", "j")

    def up_to(last: int):
        return lambda own: F.sequence(own if same else F.lit(0), F.lit(last - 1))

    rows = tiled(a, "i", mine, "j", up_to(others))
    columns = tiled(b, "j", others, "i", lambda own: F.sequence(F.lit(0), own if same else F.lit(mine - 1)))
    return rows.cogroup(columns).applyInPandas(_compared(k, same), "a long, b long, distance int")


def near_signatures(
    left: DataFrame,
    right: DataFrame,
    k: int,
    width: int = 64,
    bands: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(a, b, distance) for distinct ``signature`` values within distance ``k``, a from left.

    A value present on both sides is paired with itself at distance 0.
    """
    a = left.select(F.col("signature").alias("a")).distinct()
    b = right.select(F.col("signature").alias("b")).distinct()
    count, rows = a.count(), b.count() if rows is None else rows
    if bands is None:
        if tiles_are_cheaper(width, k, count, rows):
            a, b = (df.filter(df[0].isNotNull()) for df in (a, b))
            return _by_tiles(a, b, k, count, rows)
        search, bands = plan_bands(width, k, rows)
    else:
        search = "combinations" if k <= COMBINATION_LIMIT and bands > k else "probes"
    keys, _ = _keys_per_row(width, k, search, bands)
    a, b = _dealt(a, count, keys), _dealt(b, rows, keys)
    if search == "pairs":
        return _verified(pair_candidates(a, b, width, k, bands), k, lambda d: _first_pair(d, width, k, bands))
    if search == "combinations":
        keyed_a = _combination_keys(F.col("a"), width, k, bands)
        keyed_b = _combination_keys(F.col("b"), width, k, bands)
        first = _first_combination
    else:
        keyed_a = _probe_keys(F.col("a"), width, k, bands, spread=True)
        keyed_b = _probe_keys(F.col("b"), width, k, bands, spread=False)
        first = _first_probe
    met = _met(a.select("a", F.inline(keyed_a)), b.select("b", F.inline(keyed_b)).select("b", "n", "v"), ["n", "v"])
    return _verified(met, k, lambda d: first(d, width, k, bands))


def _verified(met: DataFrame, k: int, first) -> DataFrame:
    """Pairs within distance ``k``, each from the first key that both have."""
    difference = F.col("a").bitwiseXOR(F.col("b"))
    return (
        met.withColumn("distance", F.bit_count(difference))
        .filter(F.col("distance") <= k)
        .filter(first(difference))
        .select("a", "b", "distance")
    )


def near_links(df: DataFrame, k: int, width: int = 64, bands: int | None = None) -> DataFrame:
    """Distinct signatures of one table within distance ``k``, each unordered pair once.

    A signature is also paired with itself, standing for its identical copies.
    """
    if bands is None:
        one = df.select(F.col("signature").alias("a")).filter("a IS NOT NULL").distinct()
        rows = one.count()
        # A tile has each pair once, keys both ways round.
        if tiles_are_cheaper(width, k, rows, rows):
            return _by_tiles(one, one.toDF("b"), k, rows, rows, same=True)
    return near_signatures(df, df, k, width, bands).filter(F.col("a") <= F.col("b"))


def cross_split_pair_count(df: DataFrame, links: DataFrame) -> DataFrame:
    """How many image pairs of different splits are near but not pixel-identical.

    Counted from group sizes; no image pair is ever formed. ``df``: signature, split,
    pixel_sha256.
    """
    per_split = df.groupBy("signature", "split").agg(F.count("*").alias("n"))
    sizes = per_split.groupBy("signature").agg(
        F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("by_split"),
        F.sum("n").alias("n"),
    )

    def side(name: str) -> DataFrame:
        return sizes.select(
            F.col("signature").alias(name),
            F.col("by_split").alias(f"{name}_splits"),
            F.col("n").alias(f"{name}_n"),
        )

    both = links.join(side("a"), "a").join(side("b"), "b")
    same_split = F.aggregate(
        F.map_keys("a_splits"),
        F.lit(0).cast("bigint"),
        lambda total, s: total
        + F.try_element_at("a_splits", s)
        * F.coalesce(F.try_element_at("b_splits", s), F.lit(0).cast("bigint")),
    )
    crossing = F.col("a_n") * F.col("b_n") - same_split
    # An unordered signature pair counts each image pair once; a signature paired with
    # itself counts it twice.
    near = both.select(
        F.when(F.col("a") == F.col("b"), 1).otherwise(2) * crossing
    ).toDF("doubled")
    copies = (
        df.groupBy("pixel_sha256", "split")
        .agg(F.count("*").alias("n"))
        .groupBy("pixel_sha256")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        .select((F.col("squares") - F.col("n") * F.col("n")).alias("doubled"))
    )
    return near.union(copies).agg(
        F.coalesce(F.expr("sum(doubled) div 2"), F.lit(0).cast("bigint")).alias(
            "near_duplicate_cross_split_pairs"
        )
    )


def near_pairs(
    df: DataFrame, links: DataFrame, different: str = "split", identity: str | None = "pixel_sha256",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Image pairs behind near signatures, of different ``different`` values, with the columns ``carry`` of both.

    The full review list: as long as the answer itself. ``df``: ordinal, image_id,
    signature and the named columns; the first image of a pair has the lower ordinal.
    """
    keep = ["ordinal", "image_id", different, *carry] + ([identity] if identity else [])

    def side(name: str) -> DataFrame:
        return df.select(
            F.col("signature").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in keep]
        )

    met = links.join(side("a"), "a").join(side("b"), "b")
    apart = F.col(f"a_{different}") != F.col(f"b_{different}")
    if identity:
        apart = apart & (F.col(f"a_{identity}") != F.col(f"b_{identity}"))
    once = (F.col("a") != F.col("b")) | (F.col("a_ordinal") < F.col("b_ordinal"))
    swap = F.col("a_ordinal") > F.col("b_ordinal")
    ordered = []
    for c in ["ordinal", "image_id", different, *carry]:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        ordered += [
            F.when(swap, b).otherwise(a).alias(f"first_{c}"),
            F.when(swap, a).otherwise(b).alias(f"second_{c}"),
        ]
    return met.filter(apart & once).select(*ordered, "distance")


def signature_queue(df: DataFrame, links: DataFrame) -> DataFrame:
    """The review list by signature: (a, b, distance, a_images, b_images, pairs), links with pairs only.

    ``pairs`` is the number of image pairs of different splits and pixels behind a link, counted
    from group sizes, so a mass of copies is one row. ``near_pairs`` of some of the links
    expands them. ``df``: signature, split, pixel_sha256; equal pixels have equal signatures.
    """
    cells = df.groupBy("signature", "split", "pixel_sha256").agg(F.count("*").alias("n"))
    splits = cells.groupBy("signature", "split").agg(F.sum("n").alias("n"))
    sizes = splits.groupBy("signature").agg(
        F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("by_split"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    copies = (
        cells.groupBy("signature", "pixel_sha256")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        .groupBy("signature")
        .agg(F.sum(F.col("n") * F.col("n") - F.col("squares")).alias("copies"))
    )
    sizes = sizes.join(copies, "signature")

    def side(name: str) -> DataFrame:
        return sizes.select(
            F.col("signature").alias(name), F.col("by_split").alias(f"{name}_splits"), F.col("n").alias(f"{name}_images"),
            F.col("squares").alias(f"{name}_squares"), F.col("copies").alias(f"{name}_copies"),
        )

    same_split = F.aggregate(
        F.map_entries("a_splits"),
        F.lit(0).cast("bigint"),
        lambda total, e: total
        + e["value"] * F.coalesce(F.try_element_at("b_splits", e["key"]), F.lit(0).cast("bigint")),
    )
    alone = F.expr("(a_images * a_images - a_squares - a_copies) div 2")
    pairs = F.when(F.col("a") == F.col("b"), alone).otherwise(F.col("a_images") * F.col("b_images") - same_split)
    return (
        links.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("pairs", pairs)
        .filter("pairs > 0")
        .select("a", "b", "distance", "a_images", "b_images", "pairs")
    )


def expand_queue(df: DataFrame, queue: DataFrame, first: int, last: int) -> DataFrame:
    """The image pairs of the links that hold ranks ``first`` to ``last`` of the queue in (a, b) order.

    Each row carries ``link_rank``, the rank of its link's first pair. ``df`` as for ``near_pairs``.
    """
    ranked = running_totals(queue.select("a", "b", "distance", "pairs"), [], [F.col("a"), F.col("b")], {"upto": F.col("pairs")})
    start = F.col("upto") - F.col("pairs") + 1
    wanted = ranked.withColumn("link_rank", start).filter((F.col("link_rank") <= last) & (F.col("upto") >= first))
    links = stored(wanted.select("a", "b", "distance", "link_rank"), "queue-page")
    pairs = near_pairs(df, links.select("a", "b", "distance"))
    named = pairs.join(df.select(F.col("image_id").alias("first_image_id"), F.col("signature").alias("_s")), "first_image_id").join(
        df.select(F.col("image_id").alias("second_image_id"), F.col("signature").alias("_t")), "second_image_id"
    )
    ends = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "link_rank")
    same = (F.least("_s", "_t") == F.col("_a")) & (F.greatest("_s", "_t") == F.col("_b"))
    return named.join(ends, same).drop("_s", "_t", "_a", "_b")


def _listing_rows(df: DataFrame, limit: int) -> DataFrame:
    """The only images that can occur in the first ``limit`` pairs.

    An image preceded by ``limit`` images of its signature, split and pixels cannot:
    each of those forms an earlier pair with the same partner. Likewise one preceded by
    ``2 * limit`` of the rest of its signature and split, of which at most ``limit`` share
    the partner's pixels.
    """
    for keys, most in (
        (["signature", "split", "pixel_sha256"], limit),
        (["signature", "split"], 2 * limit),
    ):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
        df = df.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    return df


def first_candidates(df: DataFrame, links: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` near pairs in table order, the true count and a truncation flag."""
    count = cross_split_pair_count(df, links).first()[0]
    return (
        near_pairs(_listing_rows(df, limit), links)
        .orderBy("first_ordinal", "second_ordinal")
        .limit(limit)
        .withColumns({"total": F.lit(count).cast("bigint"), "truncated": F.lit(count > limit)})
    )


def orientation_links(
    df: DataFrame, phash_k: int = 12, ahash_k: int = 8, phash_bits: int = 63, ahash_bits: int = 64
) -> DataFrame:
    """Pairs of images, a before b, close in any orientation of b by either signature.

    ``df``: ordinal, image_id, family, phash ARRAY, ahash ARRAY, the unturned signature
    first. The bits must be those that signatures really have: a band of bits that are the
    same in all rows would bring every pair together. Pairs of one family are left out.
    """
    # Signatures are read a dozen times here, and costly to derive. Spark knows the size of the file, but takes an
    # array for one element: tables of all turns are larger than it believes, and merged instead of broadcast.
    df = stored(df.select("ordinal", "image_id", "family", "phash", "ahash"), "orientations")

    def closest(column: str, k: int, width: int) -> DataFrame:
        plain = df.select(F.get(column, F.lit(0)).alias("signature"))
        turned = df.select(F.explode(column).alias("signature"))
        return near_signatures(plain, turned, k, width)

    def met(column: str, links: DataFrame) -> DataFrame:
        a = df.select(
            F.get(column, F.lit(0)).alias("a"),
            F.col("ordinal").alias("first_ordinal"),
            F.col("family").alias("first_family"),
        )
        b = df.select(
            F.explode(F.array_distinct(column)).alias("b"),
            F.col("ordinal").alias("second_ordinal"),
            F.col("family").alias("second_family"),
        )
        return (
            links.join(a, "a")
            .join(b.hint("merge"), "b")
            .filter(
                (F.col("first_ordinal") < F.col("second_ordinal"))
                & (F.col("first_family") != F.col("second_family"))
            )
            .select("first_ordinal", "second_ordinal")
        )

    found = met("phash", closest("phash", phash_k, phash_bits)).union(
        met("ahash", closest("ahash", ahash_k, ahash_bits))
    ).distinct()

    def side(name: str, signature) -> DataFrame:
        plain = [F.col(c).alias(f"{name}_{c}") for c in ("ordinal", "image_id", "family")]
        return df.select(*plain, *[signature(c).alias(f"{name}_{c}") for c in ("phash", "ahash")])

    from detlake.functions.text import closest_variant

    # Pairs take along one signature of the first image, and meet the turns of the second one last.
    first, second = side("first", lambda c: F.get(c, F.lit(0))), side("second", F.col)
    both = found.join(first, "first_ordinal").join(second.hint("merge"), "second_ordinal")
    return both.select(
        "first_image_id",
        "second_image_id",
        "first_family",
        "second_family",
        closest_variant("first_phash", "second_phash").alias("phash_distance"),
        closest_variant("first_ahash", "second_ahash").alias("ahash_distance"),
    )
