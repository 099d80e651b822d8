"""Broken lines of the summary, and the checks that the batch run makes while it writes."""

import pytest
from compare import differences
from pyspark.sql import functions as F

from ledgerlight.operators import layers, quality, warehouse
from ledgerlight.plans import oracles, pipeline, registry
from ledgerlight.sources import files

D = "/root/testdata/sf0.01"


def test_lines_are_accepted_or_rejected_and_none_is_lost(spark, tmp_path):
    head = "Customer ID,Gender,Age,City,Membership Type,Total Spend,Items Purchased,Average Rating,Discount Applied,Days Since Last Purchase,Satisfaction Level\n"
    good = "1,Female,29,New York,Gold,1120.2,14,4.6,TRUE,25,Satisfied\n"
    lines = [good, "2,Male,x,Rome,Gold,1,1,4,TRUE,2,Ok\n", "3,Male\n", "4,Male,3,Rome,Gold,1,1,4,TRUE,2,Ok,more\n", ",,,,,,,,,,\n", "5,Male,30,Rome,Gold,1e3,1,4,maybe,2,\n"]
    (tmp_path / "a.csv").write_text(head + "".join(lines))
    (tmp_path / "b.csv").write_text(head + good)
    rows, rejects = files.summary_parts(spark, f"file://{tmp_path}")
    assert sorted(r[0] or 0 for r in rows.select("`Customer ID`").collect()) == [0, 1, 1]
    got = sorted((r["line"][:1], r["_source_file"]) for r in rejects.collect())
    assert got == [("2", "a.csv"), ("3", "a.csv"), ("4", "a.csv"), ("5", "a.csv")]
    places = [r["_row_seq"]["at"] for r in rejects.collect()]
    assert len({*places}) == 4
    assert rows.select("City").count() + rejects.count() == len(lines) + 1


@pytest.mark.parametrize("name", ["summary_rejects", "summary_csv_ingest"])
def test_landed_summaries_equal_their_sql(spark, name):
    assert differences(spark, registry.queries()[name], oracles.oracle_sql()[name], D) == ""


def written(tables, root):
    seen, out = {}, {}
    for name, df in tables.items():
        df, seen[name] = quality.watched(df, name)
        files.write_layer(df, f"{root}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{root}/{name}")
    return out, seen


def test_observed_figures_equal_the_key_checks(spark, tmp_path):
    tables = registry.gold(spark, D)
    tables["fact_orders"] = tables["fact_orders"].withColumn("order_id", F.when(F.col("order_id") != tables["fact_orders"].agg(F.min("order_id")).first()[0], F.col("order_id")))
    out, seen = written(tables, f"file://{tmp_path}")
    got = {r["table_name"]: r for r in quality.sound(out, seen, ()).collect()}
    for r in quality.key_checks(tables).collect():
        own = got[r["table_name"]]
        assert (own["null_keys"], own["repeated_keys"]) == (r["null_keys"], r["repeated_keys"])
    assert {n: r["n_rows"] for n, r in got.items()} == {n: df.count() for n, df in tables.items()}
    assert got["fact_orders"]["null_keys"] == 1
    with pytest.raises(ValueError, match="fact_orders: 1 null_keys"):
        quality.sound(out, seen, ("null_keys", "repeated_keys", "orphans"))


def test_repeated_keys_and_orphans_are_refused(spark, tmp_path):
    c = spark.createDataFrame([(1, "2024-01-01", "a", "SMB"), (2, "2024-01-02", "b", "SMB")], "customer_id long, signup_date string, channel string, segment string").withColumn("signup_date", F.col("signup_date").cast("date"))
    o = spark.createDataFrame([("x", 1, "2024-02-01", 5.0), ("y", 9, "2024-02-02", 6.0)], "order_id string, customer_id long, order_date string, order_value double").withColumn("order_date", F.col("order_date").cast("date"))
    out, seen = written(warehouse.star_schema(c, o), f"file://{tmp_path}/one")
    assert quality.sound(out, seen).where("table_name = 'fact_orders'").first()["orphans"] == 1
    with pytest.raises(ValueError, match="fact_orders: 1 orphans"):
        quality.sound(out, seen, ("orphans",))
    out, seen = written(warehouse.star_schema(c.unionByName(c.limit(1)), o), f"file://{tmp_path}/two")
    with pytest.raises(ValueError, match="dim_customers: 1 repeated_keys"):
        quality.sound(out, seen)


def test_the_run_refuses_repeated_keys(spark, tmp_path, monkeypatch):
    raw = {"customers": registry.T.dirty_customers(spark, "/root/testdata/sf0.001"), "orders": registry.T.dirty_orders(spark, "/root/testdata/sf0.001"), "marketing": registry.T.dirty_marketing(spark, "/root/testdata/sf0.001")}
    once = layers.silver_orders
    monkeypatch.setattr(layers, "silver_orders", lambda *a: once(*a).unionByName(once(*a)))
    with pytest.raises(ValueError, match="fact_orders: [0-9]+ repeated_keys"):
        pipeline.run(spark, raw, pipeline.Config(f"file://{tmp_path}", trees=2, depth=2, folds=0))
