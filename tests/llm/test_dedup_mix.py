import hashlib

import pytest
from pyspark.sql import functions as F

from detlake.llm.exact_dedup import deduplicate, look_up, open_index
from detlake.llm.mixing import mix, source_targets
from detlake.session import scratch_path
from tests.llm.helpers import awkward_rows, clashing, documents, prose


def test_largest_key_stays(spark):
    got = deduplicate(documents(spark)).collect()
    groups = {}
    for r in awkward_rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(awkward_rows())
    for r in got:
        ids = groups[r.text or ""]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_index_persists_and_grows(spark):
    path = scratch_path(spark, "test-index")
    first = documents(spark, [(1, "a", None, None, 0), (2, "a", None, None, 0)])
    open_index(spark, path, 4).add(first, "1")
    again = open_index(spark, path, 4)
    second = documents(spark, [(9, "a", None, None, 0), (3, "b", None, None, 0)])
    index = again.add(second, "2")
    assert sorted((r.keep_id, r.group_size, r.batch) for r in index.collect()) == [(2, 2, "1"), (3, 1, "2")]
    assert sorted((r.doc_id, r.kept) for r in look_up(second, index).collect()) == [(3, True), (9, False)]
    assert again.add(second, "3").count() == 2
    plan = again.rows().select("digest")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed" in plan


def _texts(spark, ids, word="text"):
    return documents(spark, [(i, f"{word} {i}", None, None, 0) for i in ids])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_keeps_its_buckets_and_its_own_table(spark):
    path = scratch_path(spark, "test-index")
    first = open_index(spark, path, 8)
    first.add(_texts(spark, range(1000)), "1")
    spark.sql(f"DROP TABLE {first.name}")  # as in another catalog
    again = open_index(spark, path)  # the session has 4 shuffle partitions
    assert (spark.conf.get("spark.sql.shuffle.partitions"), again.buckets) == ("4", 8)
    assert again.rows().groupBy("digest").count().count() == 1000
    assert again.add(_texts(spark, range(500, 1500)), "2").count() == 1500
    with pytest.raises(ValueError):
        open_index(spark, path, 4)
    # Paths that look alike are different indexes.
    others = [open_index(spark, f"{path}{end}") for end in ("/a/b_c", "/a/b/c", "/A/b/c")]
    assert [o.add(_texts(spark, [i]), "1").count() for i, o in enumerate(others)] == [1, 1, 1]


def test_compacted_index_is_joined_without_a_sort(spark):
    index = open_index(spark, scratch_path(spark, "test-index"), 4)
    for batch in range(5):
        index.add(_texts(spark, range(batch * 50, batch * 50 + 100)), str(batch))
    assert index.rows().count() == 300
    before = {tuple(r) for r in index.rows().collect()}
    assert {tuple(r) for r in index.compact().collect()} == before
    fresh_ = open_index(spark, index.path)
    assert (fresh_.generation, fresh_.name) == (1, index.name)
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    spark.conf.set(key, "true")
    try:
        digests = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
        text = _plan(fresh_.unknown(digests))
    finally:
        spark.conf.unset(key)
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    below = text.split("SortMergeJoin")[1]
    assert below.count("Exchange hashpartitioning(digest") == 1  # of the new rows only
    assert below.count("Sort [digest") == 1
    assert fresh_.add(_texts(spark, range(290, 310)), "6").count() == 310


def test_dedup_clashes_hot_group_and_empty(spark):
    rows = [(i, "same", None, None, 0) for i in range(3000)] + [(i, f"t{i}", None, None, 0) for i in range(3000, 6000)]
    got = deduplicate(clashing(documents(spark, rows), "KEPT", "digest", "group_size"))
    assert got.filter("kept").count() == 3001 and "digest" in got.columns
    assert deduplicate(documents(spark, [])).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, held, rest = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total >= epochs * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            held.add(s)
            target[s] = epochs * sizes[s]
            rest -= target[s]
        if len(held) == len(names):
            return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 900, "c": 5000}, {"x": 10, "y": 10, "z": 10, None: 500}, {"a": 7}])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_hits_targets_and_repeats(spark):
    rows = [(i, prose(i, 5 + i * 7 % 400), None, "abc"[i % 7 % 3], 0) for i in range(600)]
    df = documents(spark, rows)
    got = mix(df).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    again = mix(df.repartition(7)).select("doc_id", "taken").collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted(map(tuple, again))
    for s in "abc":
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 130
        assert sum(r["size"] for r in of) == of[0].source_size
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)


def test_mix_of_awkward_and_empty_tables(spark):
    got = mix(clashing(documents(spark), "SIZE", "copies", "part", "mix")).collect()
    assert len(got) == len(awkward_rows()) and all(r.taken <= 3 * r["size"] for r in got)
    assert mix(documents(spark, [])).count() == 0
