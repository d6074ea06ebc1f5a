"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

The normalised text is a lattice of pieces. A state at a position is the piece that covers
the step across it; the weight of a path is the sum of its pieces' scores for a unigram
model. A merge (BPE) model has no scores to add up, but its result is the one path on which
every two neighbouring pieces, encoded on their own, stay apart: such pairs weigh 0, all
others minus infinity. Both are the max-plus semiring.

A giant text is cut into chunks at fixed positions, wherever these fall in a word. Each
chunk yields the matrix of best weights from every state at its left edge to every state
at its right edge. Matrices are combined associatively, which fixes the states at all
edges; each chunk is then backtraced on its own. No piece holds a space mark after another
character, so all paths pass a word's start: a chunk explores only the words that its
edges cut, and its inner words, which have one way, are encoded once per worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.common import fresh, whole_text, with_computed
from detlake.session import stored

MARK = "▁"
CHUNK_CHARS = 1 << 15
KEPT_UNITS = 150_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
START, END = (0, 0), (-1, 0)
NEVER = float("-inf")


class PieceModel:
    """A model file's pieces with the two ways to weigh paths."""

    def __init__(self, path: str, unigram: bool | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = messages.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        self.unigram = spec.trainer_spec.model_type == 1 if unigram is None else unigram
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.number = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s in self.score.values() if s > -1e6) - 10
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.apart = lru_cache(1 << 16)(self._apart)

    def merge(self, text: str) -> list[str]:
        """Merges by the best score of the merged piece, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def step(self, left: str, right: str) -> float:
        """Weight of ``right`` after ``left``; no left piece is written as ""."""
        if self.unigram:
            return self.score.get(right, self.unknown)
        return 0.0 if self.apart(left, right) else NEVER

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            n = self.number.get(p)
            out += [n] if n is not None else [self.bytes[b] for b in p.encode("utf-8", "replace")]
        return out

    def paths(self, text: str, sources: dict[tuple[int, int], float], stop: int, exact: bool):
        """Best weight and predecessor of every piece (start, length) reachable from ``sources``
        up to the pieces that end at ``stop`` (or, unless ``exact``, behind it)."""
        best = {node: (w, None) for node, w in sources.items()}
        open_at: dict[int, list[tuple[int, int]]] = {}
        for start, length in sources:
            open_at.setdefault(start + length, []).append((start, length))
        for at in range(min(open_at, default=stop), stop):
            nodes = open_at.pop(at, ())
            if not nodes:
                continue
            most = (stop if exact else len(text)) - at
            for length in range(1, min(self.longest, most) + 1):
                piece = text[at : at + length]
                if length > 1 and piece not in self.score:
                    continue
                for start, size in nodes:
                    weight = self.step(text[start : start + size], piece)
                    if weight == NEVER:
                        continue
                    weight += best[start, size][0]
                    new = (at, length)
                    if new not in best:
                        open_at.setdefault(at + length, []).append(new)
                        best[new] = (weight, (start, size))
                    elif weight > best[new][0]:
                        best[new] = (weight, (start, size))
        return best

    @staticmethod
    def back(text: str, best, node) -> list[str]:
        """Pieces of the path to ``node``, without its source."""
        out = []
        while node is not None and best[node][1] is not None:
            out.append(text[node[0] : node[0] + node[1]])
            node = best[node][1]
        return out[::-1]

    def best_of(self, unit: str) -> list[str]:
        """The pieces of a text that begins and ends at word edges."""
        if not self.unigram:
            return self.merge(unit)
        best = self.paths(unit, {START: 0.0}, len(unit), True)
        ends = [n for n in best if sum(n) == len(unit) and n != START]
        return self.back(unit, best, max(ends, key=lambda n: best[n][0]))

    def weight_of(self, pieces: list[str]) -> float:
        return sum(self.score.get(p, self.unknown) for p in pieces) if self.unigram else 0.0

    def unit_ids(self, unit: str) -> bytes:
        ids = self.fresh.get(unit)
        if ids is None:
            ids = self.aged.get(unit)
            if ids is None:
                if self.unigram or unit[0] != MARK or len(unit) == 1:
                    listed = self.numbers(self.best_of(unit))
                else:  # the library puts a mark before its text
                    listed = self.library.encode(unit[1:])
                ids = np.asarray(listed, "<u4").tobytes()
            if len(self.fresh) >= KEPT_UNITS:
                self.aged, self.fresh = self.fresh, {}
            self.fresh[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known = self.unit_ids
        return b"".join([known(u) for u in _UNIT.findall(normalised(text))])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def normalised(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


@cache
def piece_model(path: str, unigram: bool | None = None) -> PieceModel:
    return PieceModel(path, unigram)


def _edges(text: str, low: int, high: int) -> tuple[int, int] | None:
    """First and last word start in [low, high], or None."""
    starts = [i for i in (_next_start(text, low, high), _last_start(text, low, high)) if i >= 0]
    return (starts[0], starts[-1]) if starts else None


def _is_start(text: str, at: int) -> bool:
    return text[at] == MARK and (at == 0 or text[at - 1] != MARK)


def _next_start(text: str, low: int, high: int) -> int:
    at = text.find(MARK, low, high)
    while at >= 0 and not _is_start(text, at):
        at = text.find(MARK, at + 1, high)
    return at


def _last_start(text: str, low: int, high: int) -> int:
    at = text.rfind(MARK, low, high)
    while at >= 0 and not _is_start(text, at):
        at = text.rfind(MARK, low, at)
    return at


class Chunk:
    """Characters [low, high) of ``text``, which holds some context on both sides."""

    def __init__(self, model: PieceModel, text: str, low: int, high: int, first: bool, last: bool):
        self.model, self.text, self.low, self.high, self.first, self.last = model, text, low, high, first, last
        self.edges = _edges(text, low, high)

    def states_in(self) -> dict[tuple[int, int], tuple[int, int]]:
        """State at the left edge -> piece of this text. States count from the edge."""
        if self.first:
            return {START: (self.low, 0)}
        found = {}
        for start in range(max(0, self.low - self.model.longest), self.low):
            for end in range(self.low, min(start + self.model.longest, len(self.text)) + 1):
                if end - start == 1 or self.text[start:end] in self.model.score:
                    found[self.low - start, end - start] = (start, end - start)
        return found

    def _state_out(self, node: tuple[int, int]) -> tuple[int, int]:
        return END if self.last else (self.high - node[0], node[1])

    def _tail(self, sources):
        best = self.model.paths(self.text, sources, self.high, self.last)
        return best, [n for n in best if n[0] < self.high <= sum(n) and n not in sources]

    def matrix(self) -> list[tuple[tuple[int, int], tuple[int, int], float]]:
        """(state in, state out, best weight), only finite ones."""
        model, out = self.model, []
        for state, node in self.states_in().items():
            if self.edges is None:
                if sum(node) >= self.high:  # one piece over the whole chunk
                    out.append((state, self._state_out(node), 0.0))
                    continue
                best, ends = self._tail({node: 0.0})
                out += [(state, self._state_out(n), best[n][0]) for n in ends]
                continue
            weight, _ = self._head(node)
            if weight > NEVER:
                out += [(state, s, weight + w) for s, w in self._right()]
        best: dict = {}
        for i, o, w in out:
            best[i, o] = max(w, best.get((i, o), NEVER))
        return [(i, o, w) for (i, o), w in best.items()]

    def _head(self, node):
        """(weight, pieces) from the left edge to the first word start."""
        stop = self.edges[0]
        if sum(node) == stop:
            return 0.0, []
        if sum(node) > stop:
            return NEVER, []
        best = self.model.paths(self.text, {node: 0.0}, stop, True)
        ends = [n for n in best if sum(n) == stop and n != node]
        if not ends:
            return NEVER, []
        end = max(ends, key=lambda n: best[n][0])
        return best[end][0], self.model.back(self.text, best, end)

    def _right(self):
        """(state out, weight) from the first word start on."""
        if not hasattr(self, "right"):
            first, final = self.edges
            inner = 0.0
            if self.model.unigram:
                units = _UNIT.findall(self.text[first:final])
                inner = sum(self.model.weight_of(self.model.best_of(u)) for u in units)
            self.best, ends = self._tail({(final, 0): 0.0})
            self.right = [(self._state_out(n), inner + self.best[n][0], n) for n in ends]
        return [(s, w) for s, w, _ in self.right]

    def trace(self, state_in: tuple[int, int], state_out: tuple[int, int]) -> bytes:
        """Ids of the pieces that start in this chunk, given the states at its edges."""
        model, node = self.model, self.states_in()[state_in]
        if self.edges is None:
            if sum(node) >= self.high:
                return b""
            best, ends = self._tail({node: 0.0})
            end = max((n for n in ends if self._state_out(n) == state_out), key=lambda n: best[n][0])
            return np.asarray(model.numbers(model.back(self.text, best, end)), "<u4").tobytes()
        head = np.asarray(model.numbers(self._head(node)[1]), "<u4").tobytes()
        self._right()
        end = max(((w, n) for s, w, n in self.right if s == state_out), key=lambda x: x[0])[1]
        inner = b"".join([model.unit_ids(u) for u in _UNIT.findall(self.text[self.edges[0] : self.edges[1]])])
        tail = model.back(self.text, self.best, end)
        return head + inner + np.asarray(model.numbers(tail), "<u4").tobytes()


def combine(left: list, right: list) -> list:
    """The max-plus product of two matrices in (in, out, weight) form; it is associative."""
    by_in: dict = {}
    for i, o, w in right:
        by_in.setdefault(i, []).append((o, w))
    best: dict = {}
    for i, m, w in left:
        for o, v in by_in.get(m, ()):
            if w + v > best.get((i, o), NEVER):
                best[i, o] = w + v
    return [(i, o, w) for (i, o), w in best.items()]


def edge_states(matrices: list[list]) -> list[tuple[int, int]]:
    """The states at all edges on the best path through the product of the matrices."""
    after = [[(END, END, 0.0)]]
    for m in reversed(matrices):
        after.append(combine(m, after[-1]))
    after.reverse()
    states = [START]
    for m, rest in zip(matrices, after[1:], strict=True):
        to_end = {i: w for i, _, w in rest}
        states.append(max(((w + to_end.get(o, NEVER), o) for i, o, w in m if i == states[-1]), key=lambda x: x[0])[1])
    return states


def cut(text: str, chunk: int, longest: int) -> list[tuple[str, int, int, bool, bool]]:
    """Chunks of a normalised text with ``longest`` characters of context on both sides."""
    starts = list(range(0, len(text), chunk))
    out = []
    for k, low in enumerate(starts):
        high = min(low + chunk, len(text))
        left = max(0, low - longest - 1)
        piece = text[left : high + longest]
        out.append((piece, low - left, high - left, k == 0, k == len(starts) - 1))
    return out


_CHUNK = "key string, k int, piece string, low int, high int, first boolean, last boolean"


def _cut_rows(path: str, unigram: bool | None, chunk: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = piece_model(path, unigram).longest
        for frame in frames:
            for key, text in frame[["key", "text"]].itertuples(index=False):
                for k, row in enumerate(cut(normalised(text), chunk, longest)):
                    yield pd.DataFrame([(key, k, *row)], columns=[c.split()[0] for c in _CHUNK.split(", ")])

    return run


def _matrix_rows(path: str, unigram: bool | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path, unigram)
        for frame in frames:
            rows = [
                (key, k, *i, *o, w)
                for key, k, piece, *place in frame.itertuples(index=False)
                for i, o, w in Chunk(model, piece, *place).matrix()
            ]
            yield pd.DataFrame(rows, columns=["key", "k", "i0", "i1", "o0", "o1", "w"])

    return run


def _state_rows(frame: pd.DataFrame) -> pd.DataFrame:
    """The states at the edges of each chunk of one text; small: a few numbers a chunk."""
    matrices = [
        [((a, b), (c, d), w) for a, b, c, d, w in part[["i0", "i1", "o0", "o1", "w"]].itertuples(index=False)]
        for _, part in frame.groupby("k")
    ]
    states = edge_states(matrices)
    rows = [(frame["key"].iloc[0], k, *a, *b) for k, (a, b) in enumerate(zip(states, states[1:], strict=False))]
    return pd.DataFrame(rows, columns=["key", "k", "i0", "i1", "o0", "o1"])


def _traced(path: str, unigram: bool | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(path, unigram)
        for frame in frames:
            ids = [
                Chunk(model, r.piece, r.low, r.high, r.first, r.last).trace((r.i0, r.i1), (r.o0, r.o1))
                for r in frame.itertuples(index=False)
            ]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "ids": ids})

    return run


def encode_giants(texts: DataFrame, path: str, chunk: int, unigram: bool | None = None) -> DataFrame:
    """(key, ids) of distinct texts (key, text): ids as packed little-endian 32-bit integers."""
    chunks = stored(texts.mapInPandas(_cut_rows(path, unigram, chunk), _CHUNK), "piece-chunks")
    matrices = chunks.repartition("key", "k").mapInPandas(
        _matrix_rows(path, unigram), "key string, k int, i0 int, i1 int, o0 int, o1 int, w double"
    )
    states = stored(
        matrices.groupBy("key").applyInPandas(_state_rows, "key string, k int, i0 int, i1 int, o0 int, o1 int"),
        "piece-states",
    )
    traced = chunks.join(states, ["key", "k"]).mapInPandas(_traced(path, unigram), "key string, k int, ids binary")
    # The ids of one text are about as many bytes as the text, which is one row already.
    parts = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return traced.groupBy("key").agg(parts.alias("parts")).select(
        "key", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )


def _ids_of(path: str):
    def start():
        model = piece_model(path)
        return lambda texts: [[model.encode(t.as_py()) for t in texts]]

    return start


def _texts_of(path: str):
    def start():
        model = piece_model(path)
        return lambda ids: [[v.as_py() if v.as_py() is None else model.decode(v.as_py()) for v in ids]]

    return start


def encode_pieces(df: DataFrame, path: str, text: str = "text", out: str = "piece_ids", chunk: int = CHUNK_CHARS) -> DataFrame:
    """``df`` with ``out``: the ids of each whole text, packed as little-endian 32-bit integers.

    No begin, end or other special tokens are added. Null counts as empty and has no ids.
    Texts of more than ``chunk`` characters go through the parallel scan, equal ones once.
    ``text`` is kept, null becomes empty; a column named like ``out`` is replaced. Repeated rows
    are coded each time; an empty table gives an empty table.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != text])
    df = df.withColumn(text, whole_text(f"`{text}`"))
    key = fresh(df, "text_key")
    giant = F.length(F.col(f"`{text}`")) > chunk
    small = with_computed(df.filter(~giant), text, {out: "binary"}, _ids_of(path), keep=True)
    large = df.filter(giant).withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    texts = large.groupBy(F.col(key).alias("key")).agg(F.first(F.col(f"`{text}`")).alias("text"))
    ids = encode_giants(texts, path, chunk).select(F.col("key").alias(key), F.col("ids").alias(out))
    return small.unionByName(large.join(ids, key).drop(key))


def decode_pieces(df: DataFrame, path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of packed ids; null ids give null, repeated rows are
    decoded each time and an empty table gives an empty table."""
    return with_computed(df, ids, {out: "string"}, _texts_of(path), keep=True)


def _reported(path: str):
    """Numbers of pieces, checksums and round trips of texts, or of texts that come with their ids."""

    def start():
        model = piece_model(path)

        def report(texts, given=None):
            counts, sums, same = [], [], []
            for i, value in enumerate(texts):
                text = value.as_py()
                ids = model.encode(text) if given is None else given[i].as_py()
                counts.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                same.append(model.decode(ids) == text.replace(MARK, " "))
            return counts, sums, same

        return report

    return start


_REPORT = "n_pieces long, ids_crc32 long, round_trip boolean"


def piece_report(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS
) -> DataFrame:
    """Per row: key, n_pieces, ids_crc32 and round_trip (decoding gives the text back).

    Decoding writes the space mark as a space, so a text that holds the mark itself comes
    back with spaces; it is compared that way. One worker encodes and decodes a text and
    keeps neither ids nor decoded text. Null counts as empty; repeated rows are reported each
    time; texts of more than ``chunk`` characters are encoded by the parallel scan, equal ones
    once; an empty table gives an empty table. Other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`"), whole_text(f"`{text}`").alias("value"))
    giant = F.length("value") > chunk
    kind = df.schema[key].dataType.simpleString()
    start, names = _reported(path), ["n_pieces", "ids_crc32", "round_trip"]

    def small_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = start()
        for batch in batches:
            made = [pa.array(c) for c in report(batch.column(1))] if batch.num_rows else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], [key, *names])

    def giant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = start()
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                made = [pa.array(c) for c in report(batch.column(1).slice(i, 1), batch.column(2).slice(i, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *made], ["text_key", *names])

    small = rows.filter(~giant).mapInArrow(small_rows, f"`{key}` {kind}, {_REPORT}")
    large = rows.filter(giant).withColumn("text_key", F.sha2("value", 256))
    texts = large.groupBy(F.col("text_key").alias("key")).agg(F.first("value").alias("text"))
    texts = stored(texts, "piece-giants")
    coded = texts.join(encode_giants(texts, path, chunk), "key").select("key", "text", "ids")
    facts = coded.mapInArrow(giant_rows, f"text_key string, {_REPORT}")
    return small.unionByName(large.select(key, "text_key").join(facts, "text_key").drop("text_key"))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_report(docs, public_tokenizers.path("piece_bpe_32k.model"))
