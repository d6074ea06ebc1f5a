"""Near duplicates, groups, splits, tiles, border corrections and validation."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from detlake.functions import geometry as G
from detlake.functions import hashing as H
from detlake.functions import text as X
from detlake.operators import components as C
from detlake.operators import grouping as R
from detlake.operators import near as N
from detlake.operators import splits as S
from detlake.operators import tiles as L
from detlake.operators import validate as V


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def near_values(seed, n, width, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(width) for _ in range(n)]
    for value in list(base):
        for _ in range(2):
            mask = sum(1 << b for b in rng.sample(range(width), rng.randint(0, flips)))
            base.append(value ^ mask)
    return base


@pytest.mark.parametrize("width, k, bands", [
    (64, 2, None), (64, 2, 3), (64, 2, 5), (64, 4, None), (63, 4, 7), (20, 1, None),
    (63, 12, 7), (63, 12, 4), (64, 8, 5), (63, 12, None),
])
def test_near_search_loses_and_repeats_nothing(spark, width, k, bands):
    values = sorted({signed(v) for v in near_values(k * 100 + width, 40, width, k + 2)})
    df = spark.createDataFrame([(v,) for v in values], "signature bigint")
    got = sorted((r["a"], r["b"], r["distance"]) for r in N.near_links(df, k, width, bands).collect())
    want = sorted(
        (a, b, ((a ^ b) & (1 << 64) - 1).bit_count())
        for a, b in itertools.combinations_with_replacement(values, 2)
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= k
    )
    assert got == want


def test_copies_are_counted_without_listing_pairs(spark):
    """A third of all rows are copies of one image."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        s = 7 if i % 3 == 0 else rng.choice([6, 5, 255, 1 << 40])
        rows.append((i, f"i{i}", s, rng.choice(["train", "validation", "test"]), f"p{s}-{rng.randint(0, 1)}"))
    df = spark.createDataFrame(rows, "ordinal bigint, image_id string, signature bigint, split string, pixel_sha256 string")
    links = N.near_links(df, 2)
    want = sum(
        1 for a, b in itertools.combinations(rows, 2)
        if a[3] != b[3] and a[4] != b[4] and (a[2] ^ b[2]).bit_count() <= 2
    )
    assert N.cross_split_pair_count(df, links).first()[0] == want
    pairs = N.near_pairs(df, links)
    assert pairs.count() == want
    listed = [(r["first_ordinal"], r["second_ordinal"]) for r in N.first_candidates(df, links, 10).collect()]
    every = sorted((r["first_ordinal"], r["second_ordinal"]) for r in pairs.collect())
    assert listed == every[:10]
    row = N.first_candidates(df, links, 10).first()
    assert row["truncated"] and row["total"] == want


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(50)]
    nodes = sorted({n for e in edges for n in e} | {999})
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = C.connected_components(df, nodes=spark.createDataFrame([(n,) for n in nodes], "n bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == label


def members(spark):
    rows = [("a", "train", "pa"), ("b", "validation", "pb"), ("c", "test", "pb"),
            ("na", "train", "n"), ("nb", "validation", "n"), ("nc", "test", "m")]
    return spark.createDataFrame(rows, "image_id string, split string, pixel_sha256 string")


def test_pairs_and_identical_pixels_form_groups(spark):
    df = members(spark)
    keyed = df.withColumn("pair_key", F.substring("image_id", -1, 1))
    pairs = R.pair_images(keyed.filter("length(image_id) = 1"), keyed.filter("length(image_id) = 2"))
    assert {r["status"] for r in pairs.collect()} == {"paired"}
    links = R.build_links(df, pairs)
    assert {r["reason"]: r["count"] for r in links.groupBy("reason").count().collect()} == {
        "source_filename_pair": 3, "identical_decoded_pixels": 2}
    groups = R.assign_groups(df, links)
    assert groups.select("group_id").distinct().count() == 1
    assert R.group_summary(groups).first()["splits"] == "test,train,validation"


def test_family_merges(spark):
    edges = spark.createDataFrame([("50", "51"), ("51", "52")], "src string, dst string")
    nodes = spark.createDataFrame([(str(n),) for n in range(50, 54)], "n string")
    got = {r["node"]: r["component"] for r in C.connected_components(edges, nodes=nodes).collect()}
    assert got == {"50": "50", "51": "50", "52": "50", "53": "53"}


def test_grouped_split_is_stable_and_complete(spark):
    groups = spark.createDataFrame([(f"g{i % 20}",) for i in range(60)], "group_id string")
    one = {r["group_id"]: r["split"] for r in S.grouped_split(groups).collect()}
    two = {r["group_id"]: r["split"] for r in S.grouped_split(groups.orderBy(F.desc("group_id"))).collect()}
    assert one == two and len(one) == 20
    assert sorted(one.values()).count("test") == 3 and sorted(one.values()).count("validation") == 3
    with pytest.raises(ValueError):
        S.grouped_split(groups.filter("group_id IN ('g1', 'g2')"))


def test_holdout_is_the_best_choice(spark):
    rng = random.Random(4)
    rows = [(f"g{i}", rng.randint(5, 30), rng.randint(0, 9), rng.randint(0, 9)) for i in range(9)]
    stats = spark.createDataFrame(rows, "group_id string, images bigint, c1 bigint, c2 bigint")
    totals = [sum(r[i] for r in rows) for i in (1, 2, 3)]

    def score(chosen):
        sums = [sum(r[i] for r in chosen) for i in (1, 2, 3)]
        if any(s == 0 or s == t for s, t in zip(sums[1:], totals[1:])):
            return float("inf")
        return sum((s / t - 0.15) ** 2 for s, t in zip(sums, totals))

    for count in (1, 2, 3):
        best = min(itertools.combinations(rows, count), key=score)
        assert S.choose_holdout(stats, count) == sorted(r[0] for r in best)


def test_training_order_covers_every_view(spark):
    views = spark.range(165).withColumnRenamed("id", "view_id")
    for budget in (1, 164, 165, 166, 330, 1053):
        rows = S.training_order(views, 11, max_steps=budget).collect()
        assert sorted(r["step"] for r in rows) == list(range(1, budget + 1))
        for p in range(budget // 165):
            assert {r["view_id"] for r in rows if r["pass"] == p} == set(range(165))


def test_stratified_sample_needs_coverage(spark):
    rows = spark.createDataFrame([(f"f{i}",) for i in range(40)], "file string")
    labels = rows.select("file", F.when(F.col("file") < "f2", 1).otherwise(2).alias("class"))
    with pytest.raises(ValueError, match="coverage"):
        S.stratified_sample(rows, labels, [1, 2], 36, 1)
    assert S.stratified_sample(rows, labels, [2], 30, 1).count() == 30


def test_tile_grid(spark):
    assert L.tile_starts(640, 1024, 256) == [0]
    assert L.tile_starts(2048, 1024, 256) == [0, 768, 1024]
    images = spark.createDataFrame([(1, 2050, 1300)], "image_id bigint, width int, height int")
    assert L.tile_grid(images, 1024, 256).select("tx1", "ty1", "tx2", "ty2").distinct().count() == 6
    assert L.tile_grid(images, 0, 0).count() == 1
    with pytest.raises(ValueError):
        L.tile_grid(images, 100, 100)


def test_labels_are_clipped_to_tiles(spark):
    tiles = spark.createDataFrame([(1, 0, 100, 100, 200, 200), (1, 1, 300, 300, 400, 400)],
                                  "image_id bigint, tile int, tx1 int, ty1 int, tx2 int, ty2 int")
    boxes = spark.createDataFrame([(1, 0, 2, 80.0, 80.0, 140.0, 150.0)],
                                  "image_id bigint, annotation_index bigint, class_id int, x1 double, y1 double, x2 double, y2 double")
    rows = {r["tile"]: r for r in L.tile_annotations(tiles, boxes).collect()}
    assert [rows[0][c] for c in ("x1", "y1", "x2", "y2", "label")] == [0, 0, 40, 50, 3]
    assert rows[1]["annotation_index"] is None and rows[1]["x1"] is None


@pytest.mark.parametrize("limit", [2000, 0])
def test_suppression_equals_the_plain_loop(spark, limit):
    from tests.test_matching import PREDICTION, iou

    rng = random.Random(9)
    rows = [(i % 3, i, 1, float(rng.randint(0, 40)), float(rng.randint(0, 40)), 20.0, 20.0, rng.choice([0.2, 0.5, 0.9]))
            for i in range(90)]
    kept = set()
    for image in range(3):
        chosen = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[7], r[1])):
            if all(iou(r[3:7], c[3:7]) <= 0.5 for c in chosen):
                chosen.append(r)
        kept |= {r[1] for r in chosen}
    got = L.suppress_overlaps(spark.createDataFrame(rows, PREDICTION), pair_limit=limit)
    assert {r["prediction_index"] for r in got.collect()} == kept


def test_border_correction(spark):
    rows = [(1.0, 1.0, 19.01, 2.0, "corrected"), (1.0, 1.0, 19.0, 2.0, "unchanged"),
            (1.0, 1.0, 19.5, 2.0, "unnormalizable"), (1.0, 1.0, 0.0, 2.0, "unnormalizable"),
            (20.0, 1.0, 0.01, 2.0, "unnormalizable"), (float("nan"), 1.0, 1.0, 1.0, "unnormalizable")]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double, want string")
    got = df.select("want", "w", G.border_correction(*"xywh", F.lit(20), F.lit(20)).alias("f")).collect()
    assert all(r["f"]["status"] == r["want"] for r in got)
    assert got[0]["f"]["w"] == pytest.approx(19.0) and got[2]["f"]["w"] == 19.5
    with pytest.raises(ValueError):
        G.border_correction(*"xywh", F.lit(20), F.lit(20), 0.5)


def test_duplicate_issues_name_the_first_seen(spark):
    rows = [(0, "a", "h1", "h1", "p1"), (1, "b", "h2", "h1", "p1"), (2, "c", "h3", "h3", "p1"), (3, "d", "h4", "h4", None)]
    files = spark.createDataFrame(rows, "ordinal int, path string, sha256 string, actual_sha256 string, pixel_sha256 string")
    assert [r["images"] for r in V.duplicate_byte_issues(files).collect()] == [["a", "b"]]
    assert [r["images"] for r in V.duplicate_pixel_issues(files).collect()] == [["a", "c"]]


def test_table_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(200).withColumn("v", F.col("id") % 7)
    one = H.table_digest(df).first()
    assert one == H.table_digest(df.orderBy(F.desc("id")).repartition(5).select("v", "id")).first()
    assert one != H.table_digest(df.withColumn("v", F.when(F.col("id") == 3, 99).otherwise(F.col("v")))).first()
    assert H.table_digest(df.union(df)).first()["rows"] == 400


def test_table_digest_moves_rows_once(spark):
    plan = H.table_digest(spark.range(200))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, and 16^5 prefixes at most


def test_table_sums_see_changes_and_repeats(spark):
    df = spark.range(200).withColumn("v", F.col("id") % 7)
    one = H.table_sums(df).first()
    assert one == H.table_sums(df.orderBy(F.desc("id")).repartition(5).select("v", "id")).first()
    assert one != H.table_sums(df.withColumn("v", F.when(F.col("id") == 3, 99).otherwise(F.col("v")))).first()
    assert H.table_sums(df.union(df)).first()["rows"] == 400
    assert H.table_sums(df.limit(0)).first()["rows"] == 0
    assert "hashpartitioning" not in H.table_sums(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_percentiles_interpolate(spark, size):
    from detlake.operators.stats import latency_summary

    rng = random.Random(size)
    values = [float(rng.randint(0, 20)) for _ in range(size)]
    row = latency_summary(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    ordered = sorted(values)

    def at(q):
        place = q * (size - 1)
        low = int(place)
        return ordered[low] + (ordered[min(low + 1, size - 1)] - ordered[low]) * (place - low)

    assert tuple(row) == pytest.approx((sum(values) / size, at(0.5), at(0.95)))


def test_text_predicates(spark):
    rows = [("12-3-4.png", "x_10eAB_1.jpg", "p/a.rf.123.jpg", "k_Cur.jpg"), ("odd.png", "TL09-2", "b.jpg", "k_Ref.jpg")]
    df = spark.createDataFrame(rows, "n string, b string, e string, p string")
    got = df.select(X.source_family("n", "numbered"), X.source_family("b", "board"), X.source_family("e", "export"), X.pair_key("p")).collect()
    assert [tuple(r) for r in got] == [("12", "10eAB", "a", "k"), (None, "TL09", "b.jpg", "k_Ref.jpg")]
    paths = ["a/b.png", "/a", "../a", "a/../b", "a\\b", "", ".", "a..b"]
    safe = spark.createDataFrame([(p,) for p in paths], "p string").select(X.safe_path("p")).collect()
    assert [r[0] for r in safe] == [True, False, False, False, False, False, False, True]
    times = ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00", "soon Z"]
    zoned = spark.createDataFrame([(t,) for t in times], "t string").select(X.zoned_timestamp("t").isNotNull()).collect()
    assert [r[0] for r in zoned] == [True, True, False, False]
