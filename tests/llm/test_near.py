import itertools
import random

import numpy as np

from detlake.llm import near_join as nj
from tests.llm.helpers import awkward_rows, clashing, documents


def sets_of(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """(links of each text, class of each text) over distinct texts, all pairs."""
    texts = sorted({r[1] or "" for r in rows})
    sets = [sets_of(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if union and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * union:
            links[i] += 1
            links[j] += 1
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    ids = {}
    for r in rows:
        ids.setdefault(root[texts.index(r[1] or "")], []).append(r[0])
    return {
        t: (links[i], min((d for d in ids[root[i]] if d is not None), default=None), len(ids[root[i]]))
        for i, t in enumerate(texts)
    }


def mutants(seed, base, copies, edits):
    random_, out = random.Random(seed), []
    for _ in range(copies):
        words = [f"w{random_.random()}" if random_.random() < edits else w for w in base]
        out.append(" ".join(words))
    return out


def rows_of(texts):
    return [(i, t, "en", "a", 0) for i, t in enumerate(texts)]


def same(spark, rows):
    want = plain(rows)
    got = nj.near_join(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.class_id, r.class_size) == want[r.text or ""], r.doc_id
    return got


def test_equals_all_pairs(spark):
    random_ = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"a{random_.randint(0, 400)}" for _ in range(random_.choice([4, 9, 60, 300]))]
        texts += mutants(g, base, 6, random_.choice([0, 0.005, 0.02, 0.05]))
    got = same(spark, rows_of(texts))
    assert sum(r.n_links for r in got) > 50


def test_components_above_a_block(spark, monkeypatch):
    base = [f"b{i}" for i in range(200)]
    rows = rows_of(mutants(1, base, 300, 0.004))
    got = same(spark, rows)
    assert max(r.n_links for r in got) > 100


def test_awkward_clashing_and_empty(spark):
    got = same(spark, awkward_rows())
    assert {r.class_id for r in got if r.doc_id in (7, 8)} == {7}
    df = clashing(documents(spark), "KEPT", "class_id", "key", "near_text_key")
    assert nj.near_join(df).count() == len(awkward_rows())
    assert nj.near_join(documents(spark, [])).count() == 0


def test_pruning_thresholds_keep_similar_pairs():
    least = nj.least_matches()
    assert list(least) == sorted(least) and len(least) == nj.HASHES // nj.STEP
    random_ = np.random.default_rng(0)
    for n, m in zip(range(nj.STEP, nj.HASHES + 1, nj.STEP), least, strict=True):
        assert (random_.binomial(n, 0.8, 20_000) >= m).mean() > 0.9999
        assert m > 0.3 * n


def test_signature_estimates_similarity():
    base = [f"c{i}" for i in range(500)]
    a, b = mutants(3, base, 2, 0.02)
    x, y = nj.shingles(a), nj.shingles(b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    s, t = (np.frombuffer(nj.signature(v), "<u2") for v in (x, y))
    assert abs((s == t).mean() - true) < 0.12


def chain(seed, length, words, step):
    """Texts that slide over one endless text by ``step`` words."""
    random_ = random.Random(seed)
    all_words = [f"c{random_.random()}" for _ in range(words + step * length)]
    return [" ".join(all_words[i * step : i * step + words]) for i in range(length)]


def test_wide_components_equal_all_pairs(spark, monkeypatch):
    """Chains and clusters above the block size: each link is counted once, none is lost."""
    monkeypatch.setattr(nj, "BLOCK", 6)
    base = [f"b{i}" for i in range(400)]
    texts = chain(1, 90, 104, 5) + chain(2, 60, 104, 10) + mutants(3, base, 30, 0.004)
    texts += mutants(4, base, 8, 0.03)
    rows = rows_of(texts) + [(1000, texts[0], "en", "a", 0), (1001, texts[150], "en", "a", 0)]
    got = same(spark, rows)
    assert sum(r.n_links for r in got) >= 2 * 300


def test_chain_costs_its_buckets(spark, monkeypatch):
    """Texts that are alike to neighbours only: work grows with the chain, not with its square."""
    monkeypatch.setattr(nj, "BLOCK", 16)

    def work(length):
        df = documents(spark, rows_of(chain(5, length, 104, 18)))
        texts = df.selectExpr("text").withColumn("key", nj.text_key(nj.F.col("text")))
        signs = texts.select("key", "text").mapInPandas(nj._signed, "key binary, sign binary").withColumn(
            "id", nj.F.conv(nj.F.hex(nj.F.substring("key", 1, 7)), 16, 10).cast("long")
        )
        near = nj.connected_components(nj._buckets(signs))
        assert near.count() > 0.9 * length and near.select("component").distinct().count() < 10
        return nj._units(signs, near).count()

    short, long = work(200), work(800)
    assert long <= 5 * short + 200 and long < 4 * 800  # pairs of blocks would be 40,000
