"""Top-k search and whitening against plain loops and a dense eigensolver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake.llm.histogram_search import op11_histogram_search, top_k_by_histogram
from detlake.llm.whitening import op13_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
USELESS = [(1000, None, 1), (1001, [1.0, None, 0.0], 1), (1002, [NAN, 0.0, 0.0], None), (1003, [0.0, -INF, 0.0], 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_top_k(rows, asks, k, scale=1024):
    """Scores of Python integers, sorted."""
    usable = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v, _ in rows
              if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, a in usable:
        if q is None or not asks(q):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in usable if i != q]
        ranked = sorted(scored)[:k]
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(ranked, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def random_rows(seed, n, d, scale=1.0):
    random = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(random.normal(0, scale, d))], 0) for i in range(n)]


@pytest.mark.parametrize(("tile", "bins"), [(16, 4), (64, 1024)])
def test_search_equals_a_plain_loop(spark, tile, bins):
    rows = random_rows(3, 150, 5)
    rows += [(200 + i, rows[0][1], 0) for i in range(40)]  # ties of one score
    rows += [(None, rows[0][1], 0), (7, rows[7][1], 0), *USELESS, (1004, [], 0), (1005, [0.0, 0.0, 0.0, 0.0, 0.0], 0)]
    got = top_k_by_histogram(vectors(spark, rows), F.col("vec_id") % 30 == 0, k=10, tile=tile, bins=bins)
    assert found(got) == plain_top_k(rows, lambda q: q % 30 == 0, 10)


def test_search_counts_no_score_twice_where_bins_reach_beyond_their_interval(spark):
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.integers(0, 12, 3) / 4], 0) for i in range(400)]
    for scale, bins in ((4, 7), (100, 10), (1024, 1024)):
        got = top_k_by_histogram(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=10, scale=scale, tile=64, bins=bins)
        assert found(got) == plain_top_k(rows, lambda q: q % 50 == 0, 10, scale)
    near = [(i, [1.0 + float(np.float32(random.uniform(-1e-3, 1e-3))) for _ in range(8)], 0) for i in range(600)]
    got = top_k_by_histogram(vectors(spark, near), F.col("vec_id") % 50 == 0, k=10)
    assert found(got) == plain_top_k(near, lambda q: q % 50 == 0, 10)


def test_search_takes_large_scores_and_few_candidates(spark):
    rows = random_rows(5, 6, 3, 3e4)
    got = top_k_by_histogram(vectors(spark, rows), F.col("vec_id") >= 4, k=10)
    assert found(got) == plain_top_k(rows, lambda q: q >= 4, 10)
    with pytest.raises(OverflowError):
        top_k_by_histogram(vectors(spark, [(0, [1e9, 1e9], 0)]), F.lit(True))


def test_search_of_nothing(spark):
    asks = F.col("vec_id") % 100 == 0
    assert top_k_by_histogram(vectors(spark, []), asks).count() == 0
    assert top_k_by_histogram(vectors(spark, USELESS), asks).count() == 0
    assert top_k_by_histogram(vectors(spark, random_rows(1, 9, 3)).filter("vec_id > 0"), asks).count() == 0
    lone = top_k_by_histogram(vectors(spark, [(0, [1.0], 0)]), asks)
    assert (lone.count(), lone.columns) == (0, ["query_id", "rank", "vec_id", "score"])


def test_search_ignores_other_columns(spark):
    rows = vectors(spark, random_rows(2, 20, 3))
    odd = rows.withColumns({n: F.lit("extra") for n in ("key", "row", "data", "low", "x", "a b.c")})
    asks = F.col("vec_id") == 3
    assert found(top_k_by_histogram(odd, asks, k=4)) == found(top_k_by_histogram(rows, asks, k=4))


def test_search_query(spark):
    got = op11_histogram_search(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label")
    assert found(got) == plain_top_k([tuple(r) for r in table.collect()], lambda q: q % 100 == 0, 10)


def dense_whitening(rows, components, scale=64, shift=1_000_000):
    """{key: whitened values}, explained shares and deviations by a dense eigensolver."""
    x = np.floor(scale * np.array([v for _, v, _ in rows], np.float32).astype(float)).astype(np.int64) + shift
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centre = (n * distinct - sums) / n
    covariance = centre.T @ centre / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, (n * x - sums) / n @ axes / np.sqrt(values), values / np.trace(covariance), ((n * x - sums) ** 2).sum(axis=1)


def grid_of(df, m):
    rows = df.orderBy("vec_id", "component").collect()
    assert [r.component for r in rows] == [*range(1, m + 1)] * (len(rows) // m)
    return rows, np.array([r.whitened for r in rows]).reshape(-1, m)


@pytest.mark.parametrize("tolerance", [None, 1e-13])
def test_whitening_equals_a_dense_eigensolver(spark, tolerance):
    random = np.random.default_rng(8)
    spread = random.normal(size=(9, 9)) * [9, 7, 5, 4, 3, 2, 1, 0.5, 0.2]
    rows = [(i, [float(c) for c in np.float32(spread @ random.normal(size=9))], 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(100)]  # copies count once in the fit
    n, want, shares, deviations = dense_whitening(rows, 4)
    got, values = grid_of(whiten(vectors(spark, rows), components=4, tolerance=tolerance), 4)
    assert n == 300 and {r.n for r in got} == {300}
    assert np.allclose(np.abs(values), np.abs(want), atol=1e-9)
    assert np.allclose(values * np.sign(values[0]), want * np.sign(want[0]), atol=1e-9)  # one sign for all rows
    assert [r.deviation for r in got[::4]] == deviations.tolist()
    assert np.allclose([r.explained for r in got[:4]], shares, rtol=1e-10)
    assert {r.identity_error for r in got}.pop() < 1e-10


def test_equal_eigenvalues_are_all_found(spark):
    # The corners of a cross: every direction has the same variance, one vector sees one only.
    rows = [(2 * a + s, [float((1 - 2 * s) * (i == a)) for i in range(6)], 0) for a in range(6) for s in range(2)]
    got, values = grid_of(whiten(vectors(spark, rows), components=6), 6)
    assert np.allclose([r.explained for r in got[:6]], 1 / 6)
    assert np.allclose(values.T @ values / 12, np.eye(6), atol=1e-12)


def test_directions_without_variance_are_no_components(spark):
    rows = [(i, [float(i), float(2 * i), 5.0], 0) for i in range(20)]
    got, values = grid_of(whiten(vectors(spark, rows)), 1)
    assert len(got) == 20 and np.allclose(got[0].explained, 1) and np.allclose(values.std(), 1)


def test_whitening_leaves_useless_vectors_out(spark):
    rows = random_rows(4, 30, 3)
    odd = [*rows, *USELESS, (1004, [], 0), (1005, [1.0, 2.0], 0), (None, rows[3][1], 0), (3, rows[3][1], 0)]
    df = vectors(spark, odd).withColumns({n: F.lit("extra") for n in ("n", "x", "component", "a b.c")})
    got = whiten(df, components=2).collect()
    keys = [r.vec_id for r in got]
    assert {k for k in keys} == {None, *range(30)} and (keys.count(3), keys.count(None), keys.count(4)) == (4, 2, 2)
    assert {r.n for r in got} == {30}


def test_whitening_of_nothing(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], USELESS, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]):
        got = whiten(vectors(spark, rows))
        assert (got.count(), got.columns) == (0, columns)


def test_whitening_query(spark):
    got, values = grid_of(op13_whitening(spark, "/root/testdata/sf0.001"), 16)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = sorted((tuple(r) for r in table.collect()), key=lambda r: r[0])
    _, want, _, deviations = dense_whitening(rows, 16)
    assert np.allclose(np.abs(values), np.abs(want), atol=1e-8)
    assert [r.deviation for r in got[::16]] == deviations.tolist()
