"""Encoding of whole texts word by word, each distinct word once per task.

For a tokenizer whose pre-tokenizer never joins text across ASCII white space and drops
that white space, the ids of a text are the ids of its words in order: normalisation
(NFC, one-for-one lower case) composes nothing across a space, special strings hold no
space, and merges stay inside a pre-token. So a word's ids can be kept and reused.

Words of ASCII and Latin-1 letters and marks are split here by the tokenizer's pattern
and merged by the byte-rank engine over the same vocabulary (ranks are ids, and the
vocabulary lists its merges in rank order, which is checked). All other words go to the
tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Entries kept per Python worker and generation; two generations bound the memory.
KEPT_WORDS = 250_000
_encoders: dict = {}

# The parts of the vocabulary file that the quick path relies on.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
_END_BYTE = b"\xff"  # never part of UTF-8
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _rank_engine(path: str):
    """A merge engine over the file's vocabulary, or None if the file has another shape."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    if model.get("end_of_word_suffix") != _WORD_END or steps[0].get("pattern") != {"Regex": _PATTERN}:
        return None
    vocabulary, made = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in made]
    if any(y <= x for x, y in zip(ids, ids[1:], strict=False)):
        return None
    import tiktoken

    special = {t["content"] for t in spec["added_tokens"]}
    byte_of, ranks = _byte_of_character(), {}
    for token, rank in vocabulary.items():
        if token in special:
            continue
        ends = token.endswith(_WORD_END) and token != _WORD_END
        body = token[: -len(_WORD_END)] if ends else token
        ranks[bytes(byte_of[c] for c in body) + _END_BYTE * ends] = rank
    engine = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return engine._core_bpe.encode_single_piece


class WordEncoder:
    """Ids of texts as packed little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.width = id_width(self.tokenizer.get_vocab_size())
        self.form = f"<u{self.width}"
        self.engine = _rank_engine(path)
        self.fresh: dict[bytes | str, bytes] = {}
        self.aged: dict[bytes | str, bytes] = {}

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.engine is None or b"<|" in word or not _PLAIN.fullmatch(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, self.form).tobytes()
        return b"".join([self._known(piece, self._merge) for piece in _PIECES.findall(text.lower())])

    def _merge(self, piece: str) -> bytes:
        return np.asarray(self.engine(piece.encode() + _END_BYTE), self.form).tobytes()

    def _known(self, key: bytes | str, make) -> bytes:
        """Words are kept under their bytes, pre-tokens under their characters."""
        ids = self.fresh.get(key)
        if ids is None:
            ids = self.aged.get(key)
            if ids is None:
                ids = make(key)
            if len(self.fresh) >= KEPT_WORDS:
                self.aged, self.fresh = self.fresh, {}
            self.fresh[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, make = self._known, self._ids
        return b"".join([known(w, make) for w in text.encode("utf-8", "replace").split()])


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
