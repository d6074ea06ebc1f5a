"""Jaccard join of texts on word shingles with Bayesian candidate pruning.

1. Texts are reduced to distinct ones by digest; each gets a MinHash signature.
2. Bands of the signature meet in buckets. A bucket is a star of edges to its least
   member, and the components of these edges hold every pair of texts that share a bucket,
   without listing pairs.
3. Inside a component, pairs are compared from signatures in steps. After each step a pair
   is dropped when the posterior probability that its similarity reaches the threshold,
   given the equal values so far, is below a tolerance. What is left is verified exactly on
   the shingle sets. Components above ``BLOCK`` texts are taken apart by their buckets (see
   ``_units``); tasks return counts and spanning edges, never lists of pairs.
4. Classes are the components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.llm.common import fresh, join_by_group, whole_text
from detlake.operators.components import connected_components
from detlake.session import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 6
HASHES = BANDS * ROWS
#: Signature values compared in one step, and the posterior below which a pair is dropped.
STEP = 32
TOLERANCE = 1e-7
#: Texts that one task compares with each other, or with as many others.
BLOCK = 256
SEED = 7


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    odd = random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
    return odd, random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    split = text.encode("utf-8", "replace").split()
    if not split:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    width = min(words, len(split))
    mixed = np.zeros(len(split) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ each[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> bytes:
    """The upper 16 bits of ``HASHES`` minima, or nothing for a text without shingles."""
    if not len(hashes):
        return b""
    odd, add = _multipliers()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    values = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for at in range(0, len(values), 256):
        low = np.minimum(low, (values[at : at + 256, None] * odd + add).min(axis=0))
    # Minima crowd near zero; a last mixing spreads them over the bits that are kept.
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        signs = [signature(shingles(t)) for t in frame["text"]]
        yield pd.DataFrame({"key": frame["key"], "sign": signs})


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest equal values of n that keep a pair.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    kept = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        kept.append(m)
    return tuple(kept)


def text_key(text: Column) -> Column:
    """The first 16 bytes of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def _banded(signs: DataFrame, *columns: str) -> DataFrame:
    """Rows (band, bucket, *columns), one for each band of each signature."""
    bands = F.posexplode(
        F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda b: F.xxhash64(b, F.substring(F.col("sign"), (b * 2 * ROWS + 1).cast("int"), 2 * ROWS)),
        )
    )
    return signs.filter(F.length("sign") > 0).select(bands.alias("band", "bucket"), *columns)


def _buckets(signs: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) of texts that share a band; ids are 64-bit key prefixes.

    Two texts that should share a prefix are merged as candidates here and told apart later.
    """
    rows = _banded(signs, "id").drop("band")
    least = rows.groupBy("bucket").agg(F.min("id").alias("dst"), F.max("id").alias("most"))
    shared = least.filter(F.col("dst") < F.col("most")).select("bucket", "dst")
    return rows.join(shared, "bucket").filter(F.col("id") != F.col("dst")).select(F.col("id").alias("src"), "dst").distinct()


def _surviving(signs: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` whose pair with ``i`` outlives every pruning step."""
    found = np.zeros(len(others), np.int64)
    for step, least in enumerate(least_matches()):
        if not len(others):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        same = found + (signs[others, part] == signs[i, part]).sum(axis=1)
        keep = same >= least
        others, found = others[keep], same[keep]
    return others


def _at_home(signs: np.ndarray, i: int, others: np.ndarray, band: int, hot: np.ndarray) -> np.ndarray:
    """Those of ``others`` that first meet ``i`` in ``band`` and in no hot component."""
    if not len(others):
        return others
    same = (signs[others] == signs[i]).reshape(len(others), BANDS, ROWS).all(axis=2)
    apart = (hot[i] < 0) | (hot[others] != hot[i])
    return others[(same.argmax(axis=1) == band) & apart]


def compare_block(
    texts: list[str],
    signs: np.ndarray,
    side: np.ndarray,
    whole: bool,
    band: int | None = None,
    hot: np.ndarray | None = None,
):
    """Links among texts, or between side 0 and side 1 if not ``whole``.

    With a ``band``, only pairs that are at home in it count. Returns (links of each text,
    spanning edges as pairs of positions).
    """
    sets = [shingles(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    links, edges, label = np.zeros(len(sets), np.int64), [], np.arange(len(sets))
    order = np.arange(len(sets))
    for i in range(len(sets)):
        others = order[i + 1 :] if whole else order[side == 1] if side[i] == 0 else order[:0]
        others = _surviving(signs, i, others)
        if band is not None:
            others = _at_home(signs, i, others, band, hot)
        if not len(others):
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.array([mark[ids[starts[j] : starts[j + 1]]].sum() for j in others])
        mark[own] = False
        union = sizes[i] + sizes[others] - both
        linked = others[both >= THRESHOLD * union - 1e-9]
        links[i] += len(linked)
        links[linked] += 1
        for root in np.unique(label[linked]):
            if root != label[i]:
                edges.append((i, int(linked[label[linked] == root][0])))
                label[label == root] = label[i]
    return links, edges


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from frames that are sorted by ``keys``."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[keys].eq(frame[keys].iloc[-1]).all(axis=1).to_numpy()
        if rest and rest[-1][keys].iloc[-1].eq(frame[keys].iloc[0]).all() and last.all():
            rest.append(frame)
            continue
        whole = pd.concat([*rest, frame[~last]]) if rest or (~last).any() else None
        if whole is not None and len(whole):
            yield from (g for _, g in whole.groupby(keys, sort=False))
        rest = [frame[last]]
    if rest:
        yield from (g for _, g in pd.concat(rest).groupby(keys, sort=False))


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, b, links): links of text a, or an edge a-b with no links."""
    out: list[tuple] = []
    for group in _grouped(frames, ["component", "low", "high"]):
        low = int(group["low"].iloc[0])
        whole = low == group["high"].iloc[0]
        keys = group["key"].tolist()
        signs = np.stack([np.frombuffer(s, "<u2") for s in group["sign"]])
        side = (group["block"] != low).to_numpy().astype(int)
        band = -1 - low if low < 0 else None
        links, edges = compare_block(
            group["text"].tolist(), signs, side, bool(whole), band, group["hot"].to_numpy()
        )
        out += [(keys[i], None, int(n)) for i, n in enumerate(links) if n]
        out += [(keys[i], keys[j], 0) for i, j in edges]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["a", "b", "links"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b", "links"])


def _homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a bucket that have a surviving pair at home in it."""
    for group in _grouped(frames, ["bucket"]):
        signs = np.stack([np.frombuffer(s, "<u2") for s in group["sign"]])
        hot, band, order = group["hot"].to_numpy(), int(group["band"].iloc[0]), np.arange(len(group))
        needed = np.zeros(len(group), bool)
        for i in order:
            others = _at_home(signs, i, _surviving(signs, i, order[i + 1 :]), band, hot)
            needed[others] = True
            needed[i] |= len(others) > 0
        yield group.loc[needed, ["key", "bucket", "band", "hot"]]


def _blocks(placed: DataFrame, hot: Column) -> DataFrame:
    """Units of work for rows (key, component, n): each pair of blocks of a component."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = placed.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", "component", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"), "block", hot.alias("hot"),
    )


def _units(signs: DataFrame, near: DataFrame) -> DataFrame:
    """Which texts meet in which unit of work: (key, component, low, high, block, hot).

    A component of at most ``BLOCK`` texts is one unit. In a larger one, buckets of more than
    ``BLOCK`` texts form hot components, whose blocks are compared with each other. Every other
    pair is at home in the first band it shares: a pass over signatures alone finds the texts
    that have a surviving pair at home in a bucket, and these make a unit (``low`` is then
    -1 - band). So a long chain of texts costs its buckets, not the square of its length.
    """
    none = F.lit(-1).cast("long")
    sizes = near.groupBy("component").agg(F.count("*").alias("n"))
    placed = signs.select("key", "id").join(near.withColumnRenamed("node", "id"), "id").join(sizes, "component")
    units = _blocks(placed.filter(F.col("n") <= BLOCK), none)
    wide = stored(placed.filter(F.col("n") > BLOCK).select("key"), "near-wide")
    if wide.isEmpty():
        return units
    signed = stored(signs.join(wide, "key"), "near-wide-signs")
    rows = _banded(signed, "key", "id")
    met = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("dst")).filter("n > 1")
    met = stored(rows.join(met, "bucket"), "near-wide-buckets")
    stars = met.filter((F.col("n") > BLOCK) & (F.col("id") != F.col("dst")))
    hot = stored(connected_components(stars.select(F.col("id").alias("src"), "dst").distinct()), "near-hot")
    sizes = hot.groupBy("component").agg(F.count("*").alias("n"))
    crowded = signed.select("key", "id").join(hot.withColumnRenamed("node", "id"), "id").join(sizes, "component")
    inside = hot.select(F.col("node").alias("id"), F.col("component").alias("hot"))
    small = met.filter(F.col("n") <= BLOCK).select("bucket", "band", "key", "id").join(inside, "id", "left")
    small = small.withColumn("hot", F.coalesce("hot", none))
    mixed = small.groupBy("bucket").agg(F.min("hot").alias("least"), F.max("hot").alias("most"))
    mixed = mixed.filter("least < 0 or least < most").select("bucket")
    homes = stored(
        small.join(mixed, "bucket").join(signed.select("key", "sign"), "key")
        .select("bucket", "band", "key", "hot", "sign")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInPandas(_homes, "key binary, bucket long, band int, hot long"),
        "near-homes",
    )
    side = -1 - F.col("band")
    met_at_home = homes.select(
        "key", F.col("bucket").alias("component"), side.alias("low"), side.alias("high"), side.alias("block"), "hot"
    )
    return units.unionByName(_blocks(crowded, F.col("component"))).unionByName(met_at_home)


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: (text_key, text_id, copies, links, class_key, class_id, class_size).

    ``links`` counts the other texts whose similarity reaches the threshold; ``class_id`` is
    the least key in the class and ``class_size`` its documents. Null counts as empty text.
    Texts without words have no links. A text whose documents all have null keys has a null
    id, and so has a class of such texts only.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), whole_text(f"`{text}`").alias("text"))
    docs = docs.withColumn("key", text_key(F.col("text")))
    texts = stored(
        docs.groupBy("key").agg(F.min("doc").alias("text_id"), F.count("*").alias("copies")), "near-texts"
    )
    signs = stored(
        docs.select("key", "text").mapInPandas(_signed, "key binary, sign binary")
        .groupBy("key").agg(F.first("sign").alias("sign"))
        .withColumn("id", F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")),
        "near-signs",
    )
    near = stored(connected_components(_buckets(signs)), "near-candidates")
    units = stored(_units(signs, near), "near-units")
    placed = signs.join(units.select("key").distinct(), "key", "left_semi")
    # One document gives the text of its copies. Joined by key and document, copies of a hot
    # text are dealt to all tasks, and only rows that came repeatedly meet afterwards.
    chosen = placed.join(texts.select(F.col("key").alias("chosen"), "text_id"), F.col("key") == F.col("chosen"))
    bodies = (
        docs.withColumnRenamed("key", "of")
        .join(chosen, (F.col("of") == F.col("key")) & F.col("doc").eqNullSafe(F.col("text_id")))
        .groupBy("key")
        .agg(*[F.first(c).alias(c) for c in ("text", "sign")])
    )
    work = bodies.join(units, "key")
    by = ["component", "low", "high"]
    found = stored(
        work.repartition(*by)
        .sortWithinPartitions(*by, "key")
        .mapInPandas(_compared, "a binary, b binary, links long"),
        "near-links",
    )
    linked = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    edges = found.filter(F.col("b").isNotNull()).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("root"))
    named = texts.join(roots, "key", "left").join(linked, "key", "left")
    named = named.select(
        "key", "text_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.coalesce("root", "key").alias("root"),
    )
    first = F.min(F.struct(F.col("text_id").isNull(), "text_id", "key"))
    classes = named.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_size"))
    return named.join(classes, "root").select(
        F.col("key").alias("text_key"), "text_id", "copies", "links",
        F.col("first.key").alias("class_key"), F.col("first.text_id").alias("class_id"), "class_size",
    )


def near_join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``class_id``, ``class_size``, ``n_links``, ``n_copies`` and ``kept``.

    ``kept`` marks the least key of each class (all rows of it, if that key and text come
    repeatedly). Columns of these names in ``df`` are replaced. An empty table gives an
    empty table.
    """
    own = ("class_id", "class_size", "n_links", "n_copies", "kept")
    df = df.drop(*[c for c in df.columns if c.lower() in own and c not in (key, text)])
    name = fresh(df, "near_text_key")
    facts = stored(near_classes(df, key, text), "near-classes").select(
        F.col("text_key").alias(name), F.col("copies").alias("n_copies"), F.struct("*").alias("near_facts")
    )
    joined = join_by_group(df.withColumn(name, text_key(whole_text(f"`{text}`"))), facts, name, "n_copies")
    first = (F.col("near_facts.class_key") == F.col(name)) & F.col(f"`{key}`").cast("long").eqNullSafe(
        F.col("near_facts.class_id")
    )
    return joined.withColumns(
        {
            "class_id": F.col("near_facts.class_id"),
            "class_size": F.col("near_facts.class_size"),
            "n_links": F.col("near_facts.links"),
            "kept": first,
        }
    ).drop(name, "near_facts")


def op3_near_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_join(docs).select("doc_id", "class_id", "class_size", "n_links", "n_copies", "kept")
