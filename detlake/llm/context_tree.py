"""Context-tree weighting over the bytes of texts.

A text is its lower-cased words, each closed by a space, then an empty word as its end. A
byte is eight binary decisions, each made in the contexts of the last 0, 1, ... ``DEPTH``
bytes. With ``across`` these run over spaces into the words before, back to the space that
opens the text; without it they end at the space before the word. Each context and decision
has a Krichevsky-Trofimov estimator over the training texts. With KT the block probability
of a node's own estimator,

    Pw(node) = KT(node)                                      at the greatest depth
    Pw(node) = (KT(node) + product of Pw(children)) / 2      elsewhere

and the probability of the next bit mixes the estimates along the path of contexts by the
weights KT / (KT + product of the children).

All training and all scored texts contribute (context, byte) pairs, which Spark counts.
Nodes below three context bytes are weighted where their last three bytes meet; the few
nodes above (at most 65,536 contexts of two bytes) are summed up from them. Texts are
scored in blocks: a block asks once for each of its distinct words and pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.llm.common import give_back, parts_for, text_bytes, whole_text
from detlake.session import stored

#: At most 6: a context and its byte are one positive 64-bit key.
DEPTH = 6
SPLIT = 3
#: Bytes of text that are scored together, and counted together; most of their pairs repeat.
BLOCK_BYTES = 64 << 20
#: Distinct words and pairs that pass one table of counts in a task; it is then emptied.
COUNTED_WORDS = 400_000
COUNTED_PAIRS = 4_000_000
#: Answers that a task holds for its blocks before it sends them, packed.
PACKED_ANSWERS = 1_000_000
#: Buckets of keys for each block, an even number; one more is taken, so that all bytes of a key count.
BUCKETS = 8
#: Bytes that are spelled out at once; fewer where a block's answers take the memory.
SPELLED_BYTES = 2 << 20
SCORED_BYTES = 1 << 19
#: Distinct pairs that wait before they are merged into a table, which sorts all of it.
WAITING_PAIRS = 1_000_000
_HALF = np.log(0.5)


def tokens(text: bytes) -> list[bytes]:
    """Words and, as an empty word, the end."""
    words = text.lower().split()
    words.append(b"")
    return words


def word_keys(words: list[bytes]) -> np.ndarray:
    """63-bit hashes as negative numbers; keys of pairs are positive."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64) | np.int64(-(1 << 63))


def pairs_of(
    texts: Iterable[list[bytes]], across: bool, at_once: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the (context, byte) pairs of all texts, in order, and the number of the text of each.

    A key holds the context bytes from the last one down, then the byte: ``DEPTH`` + 1 bytes.
    Contexts are filled up with zeros before the space that opens them.
    """
    at_once = at_once or SPELLED_BYTES
    opening = bytes(DEPTH - 1) + b" "
    held: list[bytes] = []
    of: list[int] = []
    size = 0

    def spelled() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text = opening + opening.join(held)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(lengths + DEPTH)
        for low in range(DEPTH, len(text), at_once):
            part = text[low - DEPTH : low + at_once]
            n = len(part) - DEPTH
            context = np.ndarray(n, "<i8", part + bytes(8), 0, (1,)) & ((1 << 8 * DEPTH) - 1)
            keys = context << 8 | np.frombuffer(part, np.uint8, n, DEPTH)
            at = np.arange(low, low + n)
            first, last = np.searchsorted(ends, at[[0, -1]], side="right")
            spans = np.diff(np.minimum(ends[first : last + 1], low + n), prepend=low)
            real = at >= np.repeat((ends - lengths)[first : last + 1], spans)
            yield keys[real], np.repeat(np.asarray(of)[first : last + 1], spans)[real]

    for number, words in enumerate(texts):
        for unit in [b" ".join(words)] if across else words:
            held.append(unit + b" ")
            of.append(number)
            size += len(unit) + 1 + DEPTH
            if size >= at_once:
                yield from spelled()
                held, of, size = [], [], 0
    if held:
        yield from spelled()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each comes."""
    keys = np.sort(keys)
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys))


def _counted(across: bool):
    """Counts of words and pairs in training texts; those of other texts with count 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train: Counter[bytes] = Counter()
        seen: set[bytes] = set()
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            nonlocal keys, sums
            tables = [list(c) for c in zip((keys, sums), *waiting, strict=True)]
            waiting.clear()
            keys = sums = keys[:0].copy()
            return _summed(*(np.concatenate(tables.pop(0)) for _ in range(2)))

        def drained() -> pd.DataFrame:
            for word in seen:
                train.setdefault(word, 0)
            words, counts = list(train), np.fromiter(train.values(), np.int64, len(train))
            train.clear()
            seen.clear()
            return pd.DataFrame({"key": word_keys(words), "n": counts})

        def noted(texts: Iterable[bytes], into) -> Iterator[list[bytes]]:
            for text in texts:
                words = tokens(text)
                into.update(words)
                yield words

        for frame in frames:
            for held, part in frame.groupby("held_out"):
                for pairs, _ in pairs_of(noted(part["text"], seen if held else train), across):
                    more, add = _distinct(pairs)
                    waiting.append((more, add * (not held)))
                    if sum(len(k) for k, _ in waiting) > WAITING_PAIRS:
                        keys, sums = merged()
                    if len(keys) > COUNTED_PAIRS:
                        yield pd.DataFrame({"key": keys, "n": sums})
                        keys, sums = keys[:0], sums[:0]
                    if len(train) + len(seen) > COUNTED_WORDS:
                        yield drained()
        if train or seen:
            yield drained()
        if waiting:
            keys, sums = merged()
        if len(keys):
            yield pd.DataFrame({"key": keys, "n": sums})
        give_back()

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0: recurrence up to 8, then Stirling's series."""
    low = np.where(x < 8, x, 1.0)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(low + k)
    y = np.where(x < 8, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi)
    inverse = 1 / y
    series += inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - inverse**7 / 1680
    return np.where(x < 8, series - shift, series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the probability that the KT estimator gives to so many zeros and ones."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def own_weight(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def weigh_below(keys: np.ndarray, counts: np.ndarray, split: int = SPLIT):
    """Weights of all nodes of ``split`` or more context bytes over sorted pair keys.

    Returns, per pair, the probabilities of its eight bits as seen from depth ``split``,
    and the nodes of that depth: (top context, decision, zeros, ones, log Pw).
    """
    contexts, byte = keys >> 8, keys & 255
    seen = np.empty((len(keys), 8))
    tops = []
    for k in range(8):
        decision, bit = (byte | 256) >> (8 - k), (byte >> (7 - k)) & 1
        # Contexts are sorted already, and decisions fit a byte, which is sorted by counting.
        order = np.argsort(decision.astype(np.uint8), kind="stable")
        d, c, b, n = decision[order], contexts[order], bit[order], counts[order]
        first = _firsts(d, c)
        node = np.cumsum(np.bincount(first, minlength=len(d)))[: len(d)] - 1
        ones = np.add.reduceat(n * b, first)
        zeros = np.add.reduceat(n, first) - ones
        weighted = log_kt(zeros, ones)
        d, c = d[first], c[first]
        path = np.arange(len(d))
        chance = (ones + 0.5) / (zeros + ones + 1)
        for depth in range(DEPTH - 1, split - 1, -1):
            c = c >> 8
            first = _firsts(d, c)
            up = np.cumsum(np.bincount(first, minlength=len(d)))[: len(d)] - 1
            children = np.add.reduceat(weighted, first)
            zeros, ones = np.add.reduceat(zeros, first), np.add.reduceat(ones, first)
            kt = log_kt(zeros, ones)
            weighted = _HALF + np.logaddexp(kt, children)
            path = up[path]
            own = own_weight(kt, children)[path]
            chance = own * ((ones + 0.5) / (zeros + ones + 1))[path] + (1 - own) * chance
            d, c = d[first], c[first]
        one = chance[node]
        seen[order, k] = np.where(b == 1, one, 1 - one)
        tops.append(pd.DataFrame({"top": c, "node": d, "zeros": zeros, "ones": ones, "weighted": weighted}))
    return seen, pd.concat(tops)


_BITS = [f"bit{k}" for k in range(8)]
_NODE = "top long, node int, zeros long, ones long, weighted double"
_BELOW = f"pair boolean, key long, {', '.join(b + ' double' for b in _BITS)}, {_NODE}"


def _weighed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs sorted by key; cut where the last three context bytes change."""
    rest: list[pd.DataFrame] = []

    def done(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(some)
        keys, counts = whole["key"].to_numpy(), whole["n"].to_numpy()
        seen, tops = weigh_below(keys, counts)
        columns = ["pair", "key", *_BITS, "top", "node", "zeros", "ones", "weighted"]
        pairs = pd.DataFrame(seen, columns=_BITS).assign(pair=True, key=keys)
        yield pairs.reindex(columns=columns, fill_value=0)
        yield tops.assign(pair=False).reindex(columns=columns, fill_value=0)

    shift = 8 * (DEPTH - SPLIT + 1)
    for frame in frames:
        if not len(frame):
            continue
        top = frame["key"].to_numpy() >> shift
        cut = int(np.searchsorted(top, top[-1]))
        if cut or (rest and (rest[-1]["key"].iloc[-1] >> shift) != top[-1]):
            if cut or rest:
                yield from done([*rest, frame.iloc[:cut]])
            rest = []
        rest.append(frame.iloc[cut:])
    if rest:
        yield from done(rest)
        rest = []
    give_back()


def _above(frame: pd.DataFrame, root: pd.DataFrame | None):
    """The nodes of two context bytes that share their last byte, and those above them.

    Without ``root``: the node sums of that last byte. With it: for every pair of two
    context bytes and a byte, the affine map from the chance of its bits at depth 3 to the
    mixed chance at depth 0.
    """

    def weights(zeros, ones, children):
        kt = log_kt(zeros, ones)
        return own_weight(kt, children), (ones + 0.5) / (zeros + ones + 1), _HALF + np.logaddexp(kt, children)

    two = frame.sort_values(["top", "node"], ignore_index=True)
    own2, one2, weighted2 = weights(two["zeros"].to_numpy(), two["ones"].to_numpy(), two["weighted"].to_numpy())
    last = two.assign(weighted=weighted2).groupby("node")[["zeros", "ones", "weighted"]].sum()
    own1, one1, weighted1 = weights(*(last[c].to_numpy() for c in ("zeros", "ones", "weighted")))
    if root is None:
        return last.assign(weighted=weighted1).reset_index()
    own0, one0, _ = weights(*(root[c].to_numpy() for c in ("zeros", "ones", "weighted")))
    out = []
    for level in ((own0, one0, root.index), (own1, one1, last.index)):
        table = np.zeros((2, 256))
        table[0, level[2]], table[1, level[2]] = level[0], level[1]
        out.append(table)
    leaves = two[two["node"] >= 128]
    tops, nodes = np.repeat(leaves["top"].to_numpy(), 2), np.repeat(leaves["node"].to_numpy(), 2)
    byte = (nodes << 1 | np.tile([0, 1], len(leaves))) & 255
    place = {k: i for i, k in enumerate(zip(two["top"], two["node"], strict=True))}
    add, scale = np.zeros((len(tops), 8)), np.ones((len(tops), 8))
    for k in range(8):
        decision, bit = (byte | 256) >> (8 - k), (byte >> (7 - k)) & 1
        at = np.fromiter((place[t, d] for t, d in zip(tops, decision, strict=True)), np.int64, len(tops))
        for own, one in ((own2[at], one2[at]), (out[1][0, decision], out[1][1, decision]),
                         (out[0][0, decision], out[0][1, decision])):
            chance = np.where(bit == 1, one, 1 - one)
            add[:, k] = own * chance + (1 - own) * add[:, k]
            scale[:, k] = (1 - own) * scale[:, k]
    maps = pd.DataFrame(np.hstack([add, scale]), columns=[f"{n}{k}" for n in ("add", "scale") for k in range(8)])
    return maps.assign(top=tops, byte=byte)


def pair_codes(pairs: DataFrame) -> DataFrame:
    """(key, code): log10 of the probability of the byte in its context, from (key, n)."""
    top = F.shiftright("key", 8 * (DEPTH - SPLIT + 1))
    below = stored(
        pairs.repartition(top).sortWithinPartitions("key").mapInPandas(_weighed, _BELOW), "ctw-below"
    )
    two = stored(
        below.filter(~F.col("pair"))
        .groupBy(F.shiftright("top", 8).alias("top"), "node")
        .agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]),
        "ctw-two",
    )
    by_last = two.groupBy(F.shiftright("top", 8).alias("last"))
    sums = "node int, zeros long, ones long, weighted double"
    # At most 255 rows, one a decision of the root.
    root = (
        by_last.applyInPandas(lambda f: _above(f, None), sums)
        .groupBy("node")
        .agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
        .toPandas()
        .set_index("node")
    )
    maps = by_last.applyInPandas(
        lambda f: _above(f, root),
        ", ".join(f"{n}{k} double" for n in ("add", "scale") for k in range(8)) + ", top long, byte long",
    )
    seen = below.filter("pair").select(
        "key", *_BITS, F.shiftright("key", 8 * (DEPTH - 1)).alias("top"), F.col("key").bitwiseAND(255).alias("byte")
    )
    code = F.lit(0.0)
    for k in range(8):
        code = code + F.log10(F.col(f"add{k}") + F.col(f"scale{k}") * F.col(_BITS[k]))
    return seen.join(maps, ["top", "byte"]).select("key", code.alias("code"))


def _asked(across: bool):
    """The distinct words and pairs of each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, np.ndarray] = {}

        def drained() -> Iterator[pd.DataFrame]:
            while asked:
                block, keys = asked.popitem()
                yield pd.DataFrame({"key": keys, "block": block})

        for frame in frames:
            for block, part in frame.groupby("block"):
                waiting = [asked.get(block, np.empty(0, np.int64))]

                def noted(texts: Iterable[bytes], into: list[np.ndarray]) -> Iterator[list[bytes]]:
                    for text in texts:
                        words = tokens(text)
                        into.append(word_keys(list(set(words))))
                        yield words

                words: list[np.ndarray] = []
                for pairs, _ in pairs_of(noted(part["text"], words), across):
                    waiting += [_distinct(k)[0] for k in (pairs, np.concatenate([pairs[:0], *words])) if len(k)]
                    words.clear()
                    if sum(map(len, waiting[1:])) > WAITING_PAIRS:
                        waiting = [_distinct(np.concatenate(waiting))[0]]
                keys = np.concatenate(waiting)
                asked[block] = _distinct(keys)[0] if len(keys) else keys
                if sum(map(len, asked.values())) > 2 * COUNTED_PAIRS:
                    yield from drained()
        yield from drained()
        give_back()

    return run


def _bucketed(across: bool, buckets: int):
    """The distinct words and pairs of each block, packed by the bucket of their key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _asked(across)(frames):
            keys = frame["key"].to_numpy()
            bucket = (keys % buckets).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = _firsts(bucket)
            parts = [p.tobytes() for p in np.split(keys[order], first[1:])]
            yield pd.DataFrame({"bucket": bucket[first], "block": frame["block"].iloc[0], "keys": parts})

    return run


def _answered(asked: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """The answers of one bucket to all blocks."""
    order = np.argsort(values["key"].to_numpy())
    keys, found = (values[c].to_numpy()[order] for c in ("key", "value"))

    def answers() -> Iterator[pd.DataFrame]:
        for block, wanted in zip(asked["block"], asked["keys"], strict=True):
            wanted = np.frombuffer(wanted, np.int64)
            at = np.searchsorted(keys, wanted)
            yield pd.DataFrame({"block": np.int32(block), "key": wanted, "value": found[at]})

    empty = pd.DataFrame({"block": np.empty(0, np.int32), "key": [], "value": []})
    return pd.concat([empty, *_packed(answers())])


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The answers to each block as a few rows of packed arrays, where one a key would be sorted and sent."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def drained() -> Iterator[pd.DataFrame]:
        block, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(block, kind="stable")
        first = _firsts(block[order])
        parts = ([p.tobytes() for p in np.split(c[order], first[1:])] for c in columns)
        yield pd.DataFrame(dict(zip(("block", "key", "value"), (block[order][first], *parts), strict=True)))

    for frame in frames:
        if len(frame):
            held.append(tuple(frame[c].to_numpy() for c in ("block", "key", "value")))
            size += len(frame)
        if size > PACKED_ANSWERS:
            yield from drained()
            size = 0
    if held:
        yield from drained()


def _answers(items: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All answers to a block, sorted by key; one that was drained midway may have asked twice for a key."""
    keys, values = (
        np.concatenate([np.frombuffer(part.as_buffer(), kind) for part in items[column]])
        for column, kind in (("key", np.int64), ("value", np.float64))
    )
    order = np.argsort(keys)
    keys = keys[order]
    return keys, values[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ``wanted`` keys, found in their order: a hash table would take twice the answers' memory."""
    order = np.argsort(wanted)
    wanted = wanted[order]
    first = _firsts(wanted) if len(wanted) else order
    found = np.empty(len(wanted))
    found[order] = np.repeat(values[np.searchsorted(keys, wanted[first])], np.diff(first, append=len(wanted)))
    return found


def _scored(n_train: int, distinct: int, across: bool):
    rest = np.log10(n_train + distinct + 1)

    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        keys, values = _answers(items)
        cut = int(np.searchsorted(keys, 0))
        rows: list[tuple[int, int, float, int]] = []
        held: list[list[bytes]] = []

        def noted() -> Iterator[list[bytes]]:
            size = 0
            for text in docs["text"]:
                words = tokens(text.as_py())
                held.append(words)
                size += len(text.as_buffer())
                if size >= SCORED_BYTES:
                    based()
                    size = 0
                yield words
            based()

        def based() -> None:
            """The base of the texts held, whose words are looked up together."""
            counts = _looked_up(keys[:cut], values[:cut], word_keys(list(chain.from_iterable(held))))
            parts = np.log10(counts + 1) - rest
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
            for words, end in zip(held, ends, strict=True):
                own = slice(end - len(words), end)
                known = int(np.count_nonzero(counts[own]))
                rows.append((len(words), known, parts[own].sum(), sum(map(len, words)) + len(words)))
            held.clear()

        codes = np.zeros(docs.num_rows)
        for pairs, of in pairs_of(noted(), across, SCORED_BYTES):
            codes += np.bincount(of, _looked_up(keys[cut:], values[cut:], pairs), len(codes))
        sizes, known, sums, spelled = zip(*rows, strict=True)
        columns = {"n_tokens": sizes, "n_known": known, "base_score": sums, "score": codes, "n_code_bytes": spelled}
        del keys, values
        give_back()
        return pa.table({"key": docs["key"], "held_out": docs["held_out"], **columns})

    return run


_SCORES = "key string, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_code_bytes long"


def score_texts(
    df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", across: bool = False
) -> DataFrame:
    """One row per row of ``df``: key, held_out, n_tokens, n_known, train_tokens, base_score,
    score and bits_per_byte (the code length per byte of the lower-cased, space-closed tokens).

    ``across``: contexts run into the words before; otherwise they end with the word.
    Learns from rows where ``held_out`` is false (null: false) and scores all. Null text
    counts as empty: its one token is the end. Without training rows every estimate is the
    prior's. Repeated rows and null keys are scored like others; an empty table gives none.
    """
    docs = df.select(
        F.col(f"`{key}`").cast("string").alias("key"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.encode(whole_text(f"`{text}`"), "UTF-8").alias("text"),
    )
    blocks = parts_for(text_bytes(docs), BLOCK_BYTES)
    counted = docs.select("held_out", "text").coalesce(blocks).mapInPandas(_counted(across), "key long, n long")
    model = stored(counted.groupBy("key").agg(F.sum("n").alias("n")), "ctw-counts")
    words, pairs = model.filter(F.col("key") < 0), model.filter(F.col("key") >= 0)
    facts = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")
    ).first()
    values = words.select("key", F.col("n").cast("double").alias("value")).unionByName(
        pair_codes(pairs).withColumnRenamed("code", "value")
    )
    values = stored(values, "ctw-values")
    placed = docs.withColumn(
        "block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")
    ).repartition(blocks, "block")
    # Keys travel and are answered packed: as rows they would be sorted and joined one by one.
    buckets = BUCKETS * blocks + 1
    asked = placed.mapInPandas(_bucketed(across, buckets), "bucket int, block int, keys binary")
    known = values.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    items = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(
        _answered, "block int, key binary, value binary"
    )
    scored = placed.groupBy("block").cogroup(items.groupBy("block")).applyInArrow(
        _scored(facts["n"], facts["v"], across), _SCORES
    )
    return scored.select(
        F.col("key").cast(df.schema[key].dataType).alias(key), "held_out", "n_tokens", "n_known",
        F.lit(facts["n"]).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_code_bytes")).alias("bits_per_byte"),
    )


def op2_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(docs, held_out, across=True)
