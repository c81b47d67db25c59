"""What the reports over the catalogue read and move."""

import pytest
from pyspark.sql import functions as F

from shelfseek import fixtures as fx
from shelfseek.operators import documents, joins, quality
from shelfseek.plans import registry, segments


@pytest.mark.parametrize("name", ["orphans", "duplicate_keys", "null_violations", "cascade_delete", "similar_all_pairs",
                                  "similar_count", "image_json"])
def test_reports_write_no_search_index(spark, sf, monkeypatch, name):
    """A report needs the documents alone, similarity these and the vectors; it gives the same rows beside an index."""
    def refused(*args, **options):
        raise AssertionError("an index was written")

    monkeypatch.setattr(registry, "_built", {})
    with monkeypatch.context() as only:
        only.setattr(segments, "create", refused)
        alone = sorted(map(repr, registry.QUERIES[name](spark, sf).collect()))
    registry.search_index(spark, sf)
    assert alone == sorted(map(repr, registry.QUERIES[name](spark, sf).collect()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_details_move_once(spark, sf, monkeypatch):
    """Line items are shuffled by the product alone, which the newest detail is found by."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(repr, fx.product_details(spark, sf).collect()))
        moved = exchanges(documents.latest_details(fx.product_details(spark, sf)))
        assert len(moved) == 2 and all("hashpartitioning(product_id" in line for line in moved)
        monkeypatch.setattr(fx, "MAX_SELLERS", 0)
        assert want == sorted(map(repr, fx.product_details(spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_heavy_keys_by_bins(spark, monkeypatch):
    """All keys with too many rows, whatever bins they share; keys that are all different are not grouped."""
    monkeypatch.setattr(joins, "HEAVY_ROWS", 30)
    rows = spark.range(400).selectExpr("if(id % 5 = 0, null, cast(id % 100 % (id % 3 + 2) as string)) as k", "id as n")
    want = {r["k"] for r in rows.dropna().groupBy("k").count().filter("count > 30").collect()}
    assert want
    for bins in (1, 2, 1 << 14):
        monkeypatch.setattr(joins, "KEY_BINS", bins)
        assert {r["k"] for r in joins.heavy_keys(rows, ["k"]).collect()} == want
    assert joins.heavy_keys(spark.range(2000).withColumnRenamed("id", "k"), ["k"]).isEmpty()
    assert not exchanges(joins.heavy_keys(spark.range(2000).withColumnRenamed("id", "k"), ["k"]))


def test_own_keys_are_not_counted(spark, monkeypatch):
    """Rows go by their table's own key without a search for heavy keys."""
    def refused(*args):
        raise AssertionError("counted")

    monkeypatch.setattr(quality, "split_join", refused)
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("v"))
    gone = spark.range(10, 90).select(F.col("id").cast("string").alias("key"))
    assert quality._drop(rows, "id", gone, False, own=True).count() == 10
