"""Ranked lexical search against a plain loop."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from detlake.llm import lexical
from detlake.llm.lexical import op12_lexical_search, ranked_search
from tests.llm.helpers import awkward_rows, clashing, documents, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    """The ranking as its rules say, document by document."""
    split = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc, counts in split:
            m = 100 - 90 + 90 * sum(counts.values()) * n // total
            score = 0
            for t in asked & counts.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ASKED = [(1, "The CAT, the house"), (2, None), (3, ""), (4, "Ändern été ÉTÉ 日本語"), (5, "absent words"), (6, "cat7 x1 one two b"),
         (None, "river"), (1, "The CAT, the house"), (1, "stone")]


def test_awkward_documents(spark):
    docs = [(r[0], r[1]) for r in awkward_rows()]
    assert found(ranked_search(documents(spark), items(spark, ASKED))) == plain(docs, ASKED)


@pytest.mark.parametrize("tiles", [(1, 1, 1), (2, 3, 5), (64, 512, 4096)])
def test_tiles_do_not_change_the_ranking(spark, monkeypatch, tiles):
    for name, value in zip(("ITEM_TILE", "DOCUMENT_TILE", "TERM_TILE"), tiles, strict=True):
        monkeypatch.setattr(lexical, name, value)
    choose = random.Random(4)
    docs = [(i, prose(i % 40, choose.randint(1, 60)), None, None, 0) for i in range(120)]  # with ties
    asked = [(i, prose(100 + i, 6)) for i in range(9)]
    got = ranked_search(documents(spark, docs), items(spark, asked), k=5)
    assert found(got) == plain([d[:2] for d in docs], asked, 5)


def test_batches_of_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 7)
    docs = [(i, prose(i, 50), None, None, 0) for i in range(30)]
    asked = [(i, prose(200 + i, 8)) for i in range(12)]
    got = ranked_search(documents(spark, docs), items(spark, asked), batch_bytes=100)
    assert found(got) == plain([d[:2] for d in docs], asked)


def test_best_drops_only_what_cannot_rank(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lexical, "HELD", 10)
    choose, best, all_ = random.Random(1), lexical.Best(3, 4), []
    for low in range(0, 400, 20):
        scores = np.array([[choose.randint(0, 6) for _ in range(20)] for _ in range(3)])
        best.add(0, scores, np.arange(low, low + 20)[::-1])
        all_ += [(i, -scores[i, j], low + 19 - j) for i in range(3) for j in range(20) if scores[i, j] > 0]
    want = [r for i in range(3) for r in sorted(x for x in all_ if x[0] == i)[:4]]
    assert [(i, -s, d) for i, s, d in best.prune().T.tolist()] == want


def test_clashing_columns_and_empty_tables(spark):
    docs, asked = documents(spark), items(spark, ASKED)
    odd = clashing(docs.drop("n_chars"), "key", "n", "terms", "item_id", "score")
    assert found(ranked_search(odd, asked.withColumn("doc_id", F.lit(1)))) == found(ranked_search(docs, asked))
    assert ranked_search(docs.limit(0), asked).count() == 0
    assert ranked_search(docs, asked.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = op12_lexical_search(spark, folder)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    asked = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()
    assert found(got) == plain(list(map(tuple, docs)), list(map(tuple, asked)))
