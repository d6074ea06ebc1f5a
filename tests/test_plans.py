"""Shapes of the physical plans that matter at scale, and the query catalog."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from detlake.operators import matching as M
from detlake.operators import precision as A
from detlake.operators import tiles as L
from detlake.plans import catalog
from detlake.plans import tables as T
from detlake.sources import files as S

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_matching_shuffles_each_table_once(spark, no_broadcast):
    matches = M.match_detections(T.truth(spark, SMALL), T.predictions(spark, SMALL))
    assert exchanges(matches) == 2
    # Counting per image needs no further exchange.
    assert exchanges(matches.groupBy("image_id", "category_id").count()) == 2


def test_detection_hits_shuffle_each_table_once(spark, no_broadcast):
    hits = A.detection_hits(T.truth(spark, SMALL), T.predictions(spark, SMALL))
    text = plan(hits)
    assert text.count("Exchange hashpartitioning") == 2


def test_suppression_shuffles_once(spark):
    assert exchanges(L.suppress_overlaps(T.predictions(spark, SMALL))) == 1


def test_scans_read_only_what_is_used(spark):
    some = T.predictions(spark, SMALL).filter(F.col("image_id") == 7).select("category_id")
    text = plan(some)
    assert "l_shipdate" not in text and "l_extendedprice" not in text
    assert "EqualTo(l_orderkey,7)" in text


def test_object_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "uploads").mkdir()
    (tmp_path / "uploads" / "a.b+c.png").write_bytes(b"xyz")
    listing = S.object_listing(spark, str(tmp_path))
    assert "content" not in plan(listing).split("ReadSchema")[-1]
    row = listing.first()
    assert (row["image_key"], row["length"]) == ("uploads/a.b+c.png", 3)


def test_every_query_has_sql(spark):
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()
    assert len(catalog.QUERIES) > 130
    assert catalog.QUERIES.items() <= entry.queries().items()
    assert catalog.ORACLES.items() <= entry.oracle_sql().items()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
