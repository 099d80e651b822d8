"""Layers in buckets: what is read over them needs no exchange, and hot customers keep plain files."""

import pytest
from compare import differences
from pyspark.sql import functions as F

from ledgerlight.operators import features
from ledgerlight.plans import oracles, pipeline, registry
from ledgerlight.sources import files, fixtures

D = "/root/testdata/sf0.001"


def exchanges(df):
    """What the plan shuffles by a key."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["churn_watchlist_bucketed", "customer_features_bucketed"])
def test_queries_over_buckets_equal_their_sql_without_an_exchange_on_orders(spark, no_broadcast, name):
    q = registry.queries()[name]
    assert exchanges(registry.queries()[name.removesuffix("_bucketed")](spark, D)) and exchanges(q(spark, D)) == []
    assert differences(spark, q, oracles.oracle_sql()[name], D) == ""


def test_one_file_for_each_bucket_and_month_and_earlier_tables_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(i % 40 if i % 9 else None, f"2024-0{1 + i % 3}-05", i) for i in range(500)], "customer_id long, day string, v long").withColumn("day", F.to_date("day"))
    for n in (500, 120, 0):
        got = files.write_bucketed(df.where(F.col("v") < n), f"file://{tmp_path}/t", "bucket_test", "customer_id", 4, "day")
        assert sorted(got.collect(), key=str) == sorted(df.where(F.col("v") < n).collect(), key=str)
        for month in (tmp_path / "t").glob("month_part=*"):
            assert len([*month.glob("*.parquet")]) <= 4
    plain = files.write_bucketed(df, f"file://{tmp_path}/u", "bucket_test_plain", "customer_id", 4)
    assert plain.columns == df.columns and plain.count() == 500 and len([*(tmp_path / "u").glob("*.parquet")]) == 4


def test_hot_keys_do_not_spread(spark):
    even = spark.range(1000).select((F.col("id") % 50).alias("customer_id"))
    assert files.spreads(even, "customer_id", 8) and files.spreads(even.limit(0), "customer_id", 8)
    hot = even.unionByName(spark.range(1000).select(F.lit(7).cast("long").alias("customer_id")))
    assert not files.spreads(hot, "customer_id", 16)


def test_the_run_writes_buckets(spark, tmp_path, no_broadcast):
    raw = {"customers": fixtures.dirty_customers(spark, D), "orders": fixtures.dirty_orders(spark, D), "marketing": fixtures.dirty_marketing(spark, D)}
    out = pipeline.run(spark, raw, pipeline.Config(f"file://{tmp_path}", trees=2, depth=2, folds=0, buckets=3))
    over = features.customer_features(out["silver_customers"], out["silver_orders"])
    assert exchanges(over) == []
    assert out["fact_orders"].count() == out["silver_orders"].count() and "month_part" not in out["fact_orders"].columns
    assert spark.read.parquet(f"file://{tmp_path}/silver/orders").count() == out["silver_orders"].count()
