import zlib

import numpy as np
import public_tokenizers
import pytest

from detlake.llm.token_count import count_tokens, stable_boundaries
from detlake.llm.token_files import open_shard, read_manifest, read_token_files, write_token_files
from detlake.llm.word_encoder import WordEncoder, load_tokenizer
from detlake.session import scratch_path
from tests.llm.helpers import awkward_rows, clashing, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(PATH)


def test_words_encode_as_the_library_does(tokenizer):
    encoder = WordEncoder(PATH)
    texts = ["don't I'LL WE'VE 123 4-5", "İstanbul ẞ ﬁ é x́", "a\x1cb\xa0c d", "ÀÉß-ÿ ×÷", "\x00a b\x00", "<|x <|endoftext|>y"]
    texts += [t or "" for _, t, *_ in awkward_rows()]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == ids, text


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (700, 40), (300, 2)])
def test_counts_with_any_chunks(spark, tokenizer, chunk, overlap):
    rows = [r for r in awkward_rows() if r[0] not in (8,)] + [(30, "x" * 900 + " y " + "z" * 700, "en", "a", 1)]
    got = count_tokens(documents(spark, rows), PATH, chunk_chars=chunk, overlap=overlap).select("doc_id", "n_tokens")
    want = sorted(
        ((r[0] or 0), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows
    )
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got.collect()) == want


def test_boundaries_are_white_space_where_a_token_ends():
    assert stable_boundaries("ab cd  ef", [2, 4, 5, 9], 0, 9) == {2: 1, 5: 3}
    assert stable_boundaries("ab cd", [3, 5], 0, 5) == {}


def test_counts_of_clashing_and_empty_tables(spark):
    df = clashing(documents(spark), "N_tokens", "text_key")
    got = count_tokens(df, PATH)
    assert got.count() == len(awkward_rows()) and "text_key" in got.columns
    assert count_tokens(documents(spark, []), PATH).count() == 0


def test_files_round_trip(spark, tokenizer):
    rows = awkward_rows()
    folder = scratch_path(spark, "test-token-files")
    write_token_files(clashing(documents(spark), "key", "tie"), folder, PATH, end_id=1)
    got = read_token_files(spark, folder).orderBy("start").collect()
    order = [r.key for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0)) and len(got) == len(rows)
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0] or 0, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    assert sorted(((r.key or 0), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    shard = read_manifest(spark, folder).first()
    ids, offsets, keys, null = open_shard(folder, shard["shard"])
    assert isinstance(ids, np.memmap) and ids.dtype == np.dtype("<u2") and len(ids) == shard["ids"]
    assert len(keys) == len(null) == shard["docs"] and offsets[0] == shard["base"]


def test_files_of_an_empty_table(spark):
    folder = scratch_path(spark, "test-token-files")
    assert write_token_files(documents(spark, []), folder, PATH, 1).count() == 0
    assert read_token_files(spark, folder).count() == 0
