"""Searches with pruning against plain loops: signatures, holdouts, JSON values."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from detlake.functions.text import json_equal
from detlake.operators import grouping as R
from detlake.operators import near as N
from detlake.operators import splits as S


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def planted(seed, width, k, n):
    """Signatures, some at distance k and k + 1 of others, some with every band but one differing by two."""
    rng = random.Random(seed)
    values = [rng.getrandbits(width) for _ in range(n)]
    for v in list(values)[: n // 2]:
        for d in (1, k // 2, k, k + 1):
            values.append(v ^ sum(1 << b for b in rng.sample(range(width), d)))
        spread = [rng.sample(range(o, o + s), min(2, s)) for o, s in N.band_edges(width, (k + 1) // 2 + 1)]
        equal = rng.randrange(len(spread))
        values.append(v ^ sum(1 << b for i, band in enumerate(spread) if i != equal for b in band))
    return [signed(v) for v in values]


@pytest.mark.parametrize(("width", "k"), [(63, 12), (64, 8), (64, 12), (32, 5), (28, 7)])
def test_two_band_search_loses_nothing(spark, width, k):
    values = planted(k, width, k, 60)
    df = spark.createDataFrame([(v,) for v in values], "signature bigint")
    assert N.plan_bands(width, k, len(values))[0] == "pairs"
    got = [tuple(r) for r in N.near_links(df, k, width).collect()]
    mask = (1 << 64) - 1
    want = [(a, b, ((a ^ b) & mask).bit_count()) for a, b in itertools.combinations_with_replacement(sorted(set(values)), 2)]
    assert sorted(got) == [w for w in want if w[2] <= k]  # each pair once
    assert any(w[2] == k for w in want)


def test_two_band_candidates_stay_below_all_pairs(spark):
    rng = random.Random(1)
    for n in (500, 1000, 2000):
        a, b = (spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(n)], f"{c} bigint") for c in "ab")
        assert N.pair_candidates(a, b, 63, 12, 7).count() < n * n / 50
        assert N.pair_candidates(a, b, 64, 8, 5).count() < n * n / 1000


def groups_of(n, seed):
    rng = random.Random(seed)
    return [(f"g{i:02d}", rng.randint(5, 30), rng.randint(0, 9), rng.randint(0, 9)) for i in range(n)]


STATS = "group_id string, images bigint, c1 bigint, c2 bigint"


@pytest.mark.parametrize("count", [2, 3, 4])
def test_best_holdout_is_that_of_all_choices(spark, count):
    stats = spark.createDataFrame(groups_of(13, 7), STATS)
    every = S.holdout_choices(stats, count)
    low = every.agg(F.min("score")).first()[0]
    want = every.filter(F.col("score") <= low).collect()
    got = S.best_holdouts(stats, count).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert S.choose_holdout(stats, count) == min(want, key=lambda r: r["tie"])["groups"].split("|")


def test_best_of_forty_groups(spark):
    """3.8 million choices of six: the score must beat a long random search."""
    rows = groups_of(40, 3)
    stats = spark.createDataFrame(rows, STATS)
    best = S.best_holdouts(stats, 6).first()
    chosen = set(best["groups"].split("|"))
    totals = [sum(r[i] for r in rows) for i in (1, 2, 3)]

    def score(some):
        return sum((sum(r[i] for r in some) / t - 0.15) ** 2 for i, t in zip((1, 2, 3), totals, strict=True))

    assert len(chosen) == 6 and score([r for r in rows if r[0] in chosen]) == pytest.approx(best["score"], abs=1e-15)
    rng = random.Random(5)
    assert best["score"] <= min(score(rng.sample(rows, 6)) for _ in range(20_000))


def test_no_holdout_without_coverage(spark):
    stats = spark.createDataFrame([(f"g{i}", 5, int(i == 0)) for i in range(6)], "group_id string, images bigint, c1 bigint")
    assert S.best_holdouts(stats, 2).count() == 0  # one group has the class: it can't be on both sides
    with pytest.raises(ValueError, match="both sides"):
        S.choose_holdout(stats, 2)


def same(a, b):
    """Equality of parsed JSON in which true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def test_json_equality(spark):
    texts = ["1", "1.0", "1e0", "true", "false", "0", "-0.0", '"1"', "null", "[]", "{}", "[1, 2]", "[2, 1]", '[1.0, 2.00]', '{"a": 1, "b": [true]}',
             '{"b": [true], "a": 1.0}', '{"b": [1], "a": 1}', '{"a": null}', '"a \\" 1.0"', '"a \\" 1"', "0.1", "1e-1", "1e3", "1000", "1.5e300",
             "123456789012345678901", "123456789012345678902", "0.30000000000000004", "0.3", '"\\u00e9 -1.0"', '"é -1.0"', '{"1.0": 2}', '{"1": 2}']
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r["a"], r["b"]): r["equal"] for r in df.withColumn("equal", json_equal("a", "b")).collect()}
    assert got == {(a, b): same(json.loads(a), json.loads(b)) for a, b in pairs}
    broken = spark.createDataFrame([("{", "1"), (None, "1"), ('{"a": 1, "a": 1}', "1")], "a string, b string")
    assert {r[0] for r in broken.select(json_equal("a", "b")).collect()} == {None}


def test_queue_of_copies_is_short_and_counted(spark):
    """A thousand copies of a blank picture in two splits are one row, and three with the pictures near them."""
    rows = [(i, i, "train" if i % 2 else "test", 0, f"p{i % 4}") for i in range(1000)]
    rows += [(1000 + i, 1000 + i, "train", 1 << 20 | i % 3, f"q{i}") for i in range(6)]
    images = spark.createDataFrame(rows, "image_id bigint, ordinal bigint, split string, signature bigint, pixel_sha256 string")
    links = N.near_links(images, 2, 64)
    pairs = N.near_pairs(images, links).count()
    audited = N.cross_split_pair_count(images, links).first()[0]
    queue = R.checked_queue(images, links, audited)
    assert queue.count() == 4 and queue.agg(F.sum("pairs")).first()[0] == pairs == audited
    with pytest.raises(ValueError, match="differs from the audit"):
        R.checked_queue(images, links, audited + 1)
    # A page is made of whole links: the first one holds its first ranks.
    assert N.expand_queue(images, queue, 1, 5).count() == queue.orderBy("a", "b").first()["pairs"]
    assert N.expand_queue(images, queue, 1, audited).count() == pairs
    assert N.expand_queue(images, queue, audited + 1, audited + 5).count() == 0


def test_tiles_find_every_near_pair_once(spark, monkeypatch):
    """Blocks of both sides, sign bits, repeated and missing signatures; against plain loops."""
    monkeypatch.setattr(N, "TILE", 32)
    random_ = random.Random(4)
    values = [random_.getrandbits(64) - (1 << 63) for _ in range(100)]
    values += [v ^ (1 << random_.randrange(63)) for v in values[:60]] + values[:30]
    left = spark.createDataFrame([(v,) for v in values] + [(None,)], "signature long")
    right = left.limit(70)

    def distance(x, y):
        return ((x ^ y) & (2**64 - 1)).bit_count()

    for k in (0, 3, 18):
        links = sorted(map(tuple, N.near_links(left, k, 64).collect()))
        assert links == sorted((x, y, distance(x, y)) for x in set(values) for y in set(values) if x <= y and distance(x, y) <= k)
        of_two = sorted(map(tuple, N.near_signatures(left, right, k, 64).collect()))
        assert of_two == sorted((x, y, distance(x, y)) for x in set(values) for y in set(values[:70]) if distance(x, y) <= k)


def test_a_search_that_keys_cannot_narrow_goes_by_tiles(spark):
    """Keys of two bits fewer than the rows, or thousands a row, would compare most pairs by joins."""
    assert N.tiles_are_cheaper(63, 18, 600_000, 600_000)
    assert N.tiles_are_cheaper(24, 4, 100_000, 100_000)
    assert not N.tiles_are_cheaper(64, 4, 10_000_000, 10_000_000)
    values = [(i * 2_654_435_761 % (1 << 24),) for i in range(300)]
    df = spark.createDataFrame(values, "signature long")
    assert "CoGroup" in N.near_links(df, 4, 24)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("width", "k", "bands"), [(64, 3, None), (63, 12, None), (64, 5, 3)])
def test_keys_do_not_pass_through_the_driver(spark, monkeypatch, width, k, bands):
    """A table that looks small becomes hundreds of keys a row: Spark must not broadcast them, whichever keys they are."""
    monkeypatch.setattr(N, "tiles_are_cheaper", lambda *_: False)
    values = planted(k, width, k, 40)
    links = N.near_links(spark.createDataFrame([(v,) for v in values], "signature bigint"), k, width, bands)
    got = sorted(map(tuple, links.collect()))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    mask = (1 << 64) - 1
    want = [(a, b, ((a ^ b) & mask).bit_count()) for a, b in itertools.combinations_with_replacement(sorted(set(values)), 2)]
    assert got == [w for w in want if w[2] <= k]


def test_signatures_are_dealt_by_their_keys(spark, monkeypatch):
    monkeypatch.setattr(N, "KEYED", 1_000)
    df = spark.range(100).toDF("a")
    assert N._dealt(df, 100, 231).rdd.getNumPartitions() == 24
    assert N._dealt(df, 0, 231).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("tiles", [True, False])
def test_turned_signatures_do_not_pass_through_the_driver(spark, monkeypatch, tiles):
    """Pairs equal plain loops, repeated and missing turns included; no broadcast holds the turns of images."""
    monkeypatch.setattr(N, "tiles_are_cheaper", lambda *_: tiles)
    rng = random.Random(8)
    rows = []
    for i in range(60):
        phash, ahash = ([rng.getrandbits(bits) for _ in range(4)] for bits in (63, 64))
        if i % 3:  # near a turn of an earlier image, by one signature or both
            old = rng.choice(rows)
            phash[0] = old[3][i % 4] ^ sum(1 << b for b in rng.sample(range(63), 10 + i % 5))
            phash[2] = phash[0]
            if i % 2 and old[4]:
                ahash[3] = (old[4][0] & (2**64 - 1)) ^ sum(1 << b for b in rng.sample(range(64), 6 + i % 5))
        rows.append((i, i, f"f{i % 4}", phash, [signed(h) for h in ahash] if i % 7 else None))
    df = spark.createDataFrame(rows, "ordinal long, image_id long, family string, phash array<long>, ahash array<long>")

    def closest(one, turns):
        return min(((one[0] ^ t) & (2**64 - 1)).bit_count() for t in turns) if one and turns else None

    want = []
    for a, b in itertools.combinations(rows, 2):
        p, q = closest(a[3], b[3]), closest(a[4], b[4])
        if a[2] != b[2] and (p <= 12 or (q is not None and q <= 8)):
            want.append((a[1], b[1], a[2], b[2], p, q))
    links = N.orientation_links(df)
    assert sorted(map(tuple, links.collect())) == sorted(want) and want
    lines = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-*()0123456789")) > depth, lines[at + 1 :])
            assert not any("Generate" in x or "second_phash" in x for x in below)
