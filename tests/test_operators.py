import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import clamp, scored_action
from ledgerlight.operators import features, layers, metrics, ml, quality, ranking, recommend, warehouse
from ledgerlight.plans import pipeline, registry
from ledgerlight.sources import files, fixtures
from ledgerlight.streaming import jobs

D = "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def small(spark):
    c = spark.createDataFrame([(1, day("2025-01-01"), "Organic", "SMB"), (2, day("2025-01-03"), "Paid Search", "Enterprise")], "customer_id long, signup_date date, channel string, segment string")
    o = spark.createDataFrame([("O1", 1, day("2025-01-10"), 100.0), ("O2", 2, day("2025-01-15"), 300.0)], "order_id string, customer_id long, order_date date, order_value double")
    return c, o.withColumn("order_value", F.col("order_value").cast("decimal(12,2)"))


def test_silver_drops_orders_of_unknown_customers(spark):
    c = spark.createDataFrame([("1", "2025-01-01", "Organic", "SMB", 0), ("2", "2025-01-02", "Paid Search", "Mid-Market", 1)], "customer_id string, signup_date string, channel string, segment string, _row_seq long")
    o = spark.createDataFrame([("O1", "1", "2025-01-10", "120.0", 0), ("O2", "999", "2025-01-11", "200.0", 1)], "order_id string, customer_id string, order_date string, order_value string, _row_seq long")
    assert [r["order_id"] for r in layers.silver_orders(o, c).collect()] == ["O1"]


def test_first_row_wins_before_any_filter(spark):
    c = spark.createDataFrame([("1", "2025-01-01", None, "SMB", 0), ("1", "2025-01-01", "Organic", "SMB", 1)], "customer_id string, signup_date string, channel string, segment string, _row_seq long")
    o = spark.createDataFrame(
        [("A", "1", "2025-01-10", "-1", 0), ("A", "1", "2025-01-10", "5", 1), ("B", "1", "bad", "5", 2), ("C", "1", "2025-01-10", "n/a", 3), ("D", "1", "2025-01-10", "7.5", 5), ("D", "1", "2025-01-10", "8", 4), (None, "1", "2025-01-10", "9", 6)],
        "order_id string, customer_id string, order_date string, order_value string, _row_seq long",
    ).repartition(4)
    assert [(r["order_id"], float(r["order_value"])) for r in layers.silver_orders(o, c).collect()] == [("D", 8.0)]
    assert layers.silver_customers(c).count() == 0  # the first copy lacks its channel; its orders stay as orphans
    with pytest.raises(ValueError, match="order_date"):
        layers.silver_orders(o.drop("order_date"), c)
    m = spark.createDataFrame([("Organic", "10", 0), ("Organic", "99", 1), ("Referral", "-5", 2), ("Other", "x", 3), (None, "1", 4)], "channel string, marketing_spend string, _row_seq long")
    assert sorted(map(tuple, layers.silver_marketing(m).collect())) == [("Organic", 10.0), ("Other", 0.0), ("Referral", 0.0)]
    assert layers.rejected_ids(spark.createDataFrame([("x",), ("3",)], "customer_id string"), "customer_id").count() == 1


def test_star_schema(spark, small):
    g = warehouse.star_schema(*small)
    assert g["dim_date"].count() == 6 and g["dim_channel"].count() == 2
    assert sorted((r["order_id"], r["date_key"], r["channel_key"]) for r in g["fact_orders"].collect()) == [("O1", 20250110, 1), ("O2", 20250115, 2)]
    assert g["dim_date"].where("date_key = 20250112").first()["day_of_week"] == 7
    assert all(r["present"] for r in quality.contract_report(g).collect())
    warehouse.create_tables(spark)
    assert spark.table("fact_orders").columns == [c.split()[0] for c in warehouse.TABLES["fact_orders"].split(", ")]


def test_empty_tables(spark, small):
    c, o = small[0].limit(0), small[1].limit(0)
    assert features.customer_features(c, o).count() == 0
    assert all(df.count() == 0 for df in warehouse.star_schema(c, o).values())
    assert metrics.rfm_segments(o, c).count() == 0 and metrics.cohort_retention(o, c).count() == 0


@pytest.mark.parametrize("n, sizes", [(1, [1]), (5, [2, 1, 1, 1]), (6, [2, 1, 1, 2]), (7, [2, 2, 1, 2]), (8, [2, 2, 2, 2]), (10, [3, 2, 2, 3])])
def test_quartile_sizes(spark, n, sizes):
    df = spark.createDataFrame([(i, i % 3) for i in range(n)], "id long, v long").repartition(3)
    got = [r["n"] for r in ranking.quartiles(df, "v", "id", "q").groupBy("q").agg(F.count(F.lit(1)).alias("n")).orderBy("q").collect()]
    assert got == sizes


def test_global_ranks_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(500)], "id long, v long")
    seen = [sorted(map(tuple, ranking.global_row_number(df.repartition(n), [F.col("v").asc(), F.col("id").asc()]).collect())) for n in (1, 7)]
    assert seen[0] == seen[1]
    ranked = ranking.global_row_number(df, [F.col("v").asc(), F.col("id").asc()], "_rk")
    import pandas as pd

    values = pd.Series([(i * 37) % 11 for i in range(500)])
    got = {r["id"]: r["p"] for r in ranking.percent_rank_average(ranked, "v", "p").collect()}
    assert [got[i] for i in range(500)] == pytest.approx(values.rank(pct=True).tolist())
    q = ranking.exact_quantiles(ranked, "v", {"a": 0.3, "b": 0.77}).first()
    assert (q["a"], q["b"]) == pytest.approx((values.quantile(0.3), values.quantile(0.77)))


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(200)], "id long, y int")
    got = ranking.stratified_folds(df, "y", "id", 4).groupBy("fold", "y").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in got if r["y"] == y]
        assert len(n) == 4 and max(n) - min(n) <= 1
    s = ranking.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in s} == {(0, "train"): 137, (0, "test"): 34, (1, "train"): 23, (1, "test"): 6}


def test_clamp_keeps_null_and_actions_follow_thresholds(spark):
    df = spark.createDataFrame([(None, 0.1), (0.01, 0.6), (0.7, 0.9), (0.25, 0.35), (0.3, 0.5)], "a double, b double")
    rows = df.select(clamp(F.col("a"), 0.05, 0.5).alias("c"), scored_action(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["c"] for r in rows] == [None, 0.05, 0.5, 0.25, 0.3]
    assert [r["x"] for r in rows] == ["Nurture", "Upsell Offer", "Retention Campaign", "Reduce Acquisition Spend", "Nurture"]


def test_outcomes_of_known_actions(spark):
    rows = [(1, "Organic", "SMB", 2000.0, 100.0, 20.0, 0.8, 0.4, 0.9, "Retention Campaign"), (2, "Organic", "SMB", 2500.0, 100.0, 25.0, 0.3, 0.7, 0.8, "Upsell Offer"), (3, "Referral", "SMB", 1800.0, 100.0, 18.0, 0.5, 0.5, 0.7, "Nurture"), (4, "Referral", "SMB", 500.0, 300.0, 1.7, 0.5, 0.2, 0.1, "Reduce Acquisition Spend")]
    rec = spark.createDataFrame(rows, recommend.COLUMNS)
    got = [(r["customer_id"], r["expected_uplift"], r["action_cost"], r["net_impact"], r["roi_simulated"]) for r in recommend.top_action_outcomes(rec, 3).collect()]
    want = [(1, 560.0, 160.0, 400.0, 2.5), (2, 262.5, 125.0, 137.5, 1.1), (3, 27.0, 36.0, -9.0, -0.25)]
    assert [x for r in got for x in r] == pytest.approx([x for r in want for x in r])
    assert recommend.sliced(rec, channel="Referral", action="Nurture").count() == 1


def test_unit_economics_is_zero_where_undefined(spark):
    values = spark.createDataFrame([("a", 0.0)], "channel string, arpu double")
    cac = spark.createDataFrame([("a", 10.0, 1, 10.0), ("b", 5.0, 1, 5.0)], "channel string, marketing_spend double, customers_acquired long, cac double")
    got = metrics.unit_economics(values, cac).collect()
    assert {(r["channel"], r["payback_period_months"], r["pays_back"]) for r in got} == {("a", 0.0, False), ("b", 0.0, False)}


def test_record_rules(spark):
    rows = [(1, 2, 3, 1.0, 1.0, 1.0, "a", "b"), (-1, 2, 3, 1.0, float("nan"), 1.0, "", "b"), (1, None, 3, 1.0, 1.0, -0.5, "a", None)]
    df = spark.createDataFrame(rows, "recency_days int, frequency int, tenure_days int, monetary double, avg_order_value double, arpu double, channel string, segment string")
    assert [r["_errors"] for r in quality.validated_records(df).collect()] == [[], ["recency_days", "avg_order_value", "channel"], ["frequency", "arpu", "segment"]]
    assert quality.accepted(df).count() == 1 and quality.rejected(df).count() == 2


def test_roc_and_fingerprint(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    got = [(r["threshold"], r["fpr"], r["tpr"], r["precision"]) for r in ml.roc_points(df).orderBy(F.desc("threshold")).collect()]
    assert got == [(0.9, 0.0, 0.5, 1.0), (0.8, 0.5, 1.0, 2 / 3), (0.1, 1.0, 1.0, 0.5)]
    assert ml.fingerprint(df).first() == ml.fingerprint(df.repartition(3)).first() != ml.fingerprint(df.limit(3)).first()


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('run')}"
    raw = {"customers": fixtures.dirty_customers(spark, D), "orders": fixtures.dirty_orders(spark, D), "marketing": fixtures.dirty_marketing(spark, D)}
    return root, pipeline.run(spark, raw, pipeline.Config(root, trees=8, depth=4, folds=2))


def test_batch_run(spark, published):
    root, out = published
    assert out["fact_orders"].count() == out["silver_orders"].count()
    assert all(r["repeated_keys"] == r["null_keys"] == 0 for r in quality.key_checks({k: out[k] for k in quality.KEYS}).collect())
    assert out["cohort_retention"].where("not retention_rate between 0 and 1").count() == 0
    assert out["top_10_actions"].count() == 10 and out["recommendations"].count() == out["customer_features"].count()
    report = json.loads(spark.read.text(f"{root}/reports/executive_report").first()[0])
    assert len(report["recommendations_top_20"]) == 20 and report["base_size"]["customers_in_scope"] == out["recommendations"].count()
    assert set(report["model_performance"]) == {"churn", "next_purchase_30d"} and report["top_kpis"]["avg_ltv"] > 0
    assert spark.table("processed_fact_orders").count() == out["fact_orders"].count()
    for r in out["model_metrics"].collect():
        assert r["split_strategy"] in ("temporal", "stratified_fallback", "temporal_single_class") and r["train_size"] > 0


def test_reloaded_models_give_the_published_scores(spark, published):
    root, out = published
    registry_ = ml.Registry(spark, f"{root}/registry")
    churn, meta = registry_.load("churn")
    again = ml.scores(churn, out["customer_features"], "churn_probability").select("customer_id", F.col("churn_probability").alias("p"))
    worst = again.join(out["scored_customers"], "customer_id").agg(F.max(F.abs(F.col("p") - F.col("churn_probability")))).first()[0]
    assert worst < 1e-12 and meta["model_version"] == "model_v1"
    with pytest.raises(FileNotFoundError):
        registry_.load("other")
    trained = ml.Trained("churn", churn, {"a": 1}, again)
    assert registry_.register(trained, "v", "is_churned")["model_version_number"] == 2 and registry_.load("churn")[1]["model_version"] == "model_v2"
    assert registry_.latest("churn")["latest_model_version"] == "model_v2" and registry_.load("churn", "v")[1]["data_version"] == "v"
    with pytest.raises(FileNotFoundError):
        registry_.load("churn", "other state")


def test_single_class_is_refused(spark, published):
    f = published[1]["customer_features"].withColumn("is_churned", F.lit(1))
    with pytest.raises(ValueError, match="single class"):
        ml.train(f, "churn", "is_churned")


def test_stream_scores_equal_batch_scores(spark, published, tmp_path):
    root, _ = published
    churn, following = (ml.Registry(spark, f"{root}/registry").load(n)[0] for n in ("churn", "next_purchase_30d"))
    records = registry.records(spark, D)
    path, out = f"file://{tmp_path}/records", f"file://{tmp_path}/out"
    records.write.parquet(path)
    jobs.scored_stream(jobs.table_stream(spark, path), churn, following, {"churn": "model_v1"}, out)
    key = ["record_id", "churn_probability", "next_purchase_probability", "suggested_action"]
    want = sorted(map(tuple, ml.batch_scores(records, churn, following, {"churn": "model_v1"}).select(*key).collect()))
    got = spark.read.parquet(f"{out}/predictions")
    assert sorted(map(tuple, got.select(*key).collect())) == want
    assert spark.read.parquet(f"{out}/rejects").count() + len(want) == records.count()


def test_landing_takes_new_files_only(spark, tmp_path):
    path, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/bronze"
    for lo in (0, 10):
        spark.range(lo, lo + 10).write.mode("append").parquet(path)
        jobs.landed(jobs.table_stream(spark, path), out)
        assert spark.read.parquet(out).count() == lo + 10
    assert {"_source_file", "_ingestion_ts"} <= set(spark.read.parquet(out).columns)


def test_summary_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Customer ID,Gender,Age,City,Membership Type,Total Spend,Items Purchased,Average Rating,Discount Applied,Days Since Last Purchase,Satisfaction Level\n"
        "101,Female,29,A,Gold,1120.2,14,4.6,TRUE,25,Satisfied\n102,Male,34,B,Other,780.5,11,4.1,FALSE,,\n103,x,notanumber,C,Bronze,1,1,1,TRUE,0,Neutral\n"
    )
    got = layers.customers_from_summary(files.read_summary_csv(spark, f"file://{tmp_path}/s.csv")).orderBy("customer_id").collect()
    assert [(r["customer_id"], r["segment"], r["recency_days"]) for r in got] == [(101, "Enterprise", 25), (102, "SMB", 30), (103, "SMB", 1)]
    assert got[2]["_corrupt_record"] is not None
    assert len(files.load_published(spark, f"file://{tmp_path}", [])) == 0


def test_published_tables_and_reports_are_loaded_or_raise(spark, published):
    root, out = published
    got = files.load_published(spark, root, ["recommendations", "cohort_retention", "unit_economics", "top_10_actions"], ["executive_report", "executive_summary", "business_outcomes"])
    assert got["recommendations"].count() == out["recommendations"].count() and got["top_10_actions"].count() == 10
    summary, outcomes = got["executive_summary"], got["business_outcomes"]
    assert {"data_refresh_utc", "kpis", "ltv_cac_by_channel", "top_churn_risk_customers", "top_20_recommended_actions"} == set(summary)
    ratios = [r["ltv_cac_ratio"] for r in summary["ltv_cac_by_channel"]]
    assert ratios == sorted(ratios, reverse=True) and len(summary["top_churn_risk_customers"]) == len(summary["top_20_recommended_actions"]) == 20
    assert {"data_refresh_utc", "kpis", "ltv_cac_by_channel", "simulation_assumptions", "simulation_summary_top10", "top_10_actions"} == set(outcomes)
    assert [r["priority_rank"] for r in outcomes["top_10_actions"]] == [*range(1, 11)] and outcomes["simulation_assumptions"]["Nurture"] == {"uplift_rate": 0.03, "cost_rate": 0.02, "base": "ltv"}
    for missing in ((["nothing"], []), ([], ["nothing"])):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            files.load_published(spark, root, *missing)


def test_reports_of_three_recommendations(spark):
    rows = [(i, f"c{i}", "SMB", 1000.0 * i, 100.0, 10.0 * i, 0.2 * i, 0.5, 1.0 - 0.2 * i, "Nurture") for i in (1, 2, 3)]
    rec = spark.createDataFrame(rows, recommend.COLUMNS)
    unit = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", None)], "channel string, ltv_cac_ratio double")
    scored = spark.createDataFrame([(100.0, 10.0), (200.0, 20.0)], "monetary double, arpu double")
    summary = json.loads(recommend.executive_summary(rec, scored, unit).toJSON().first())
    assert [r["channel"] for r in summary["ltv_cac_by_channel"]] == ["b", "a", "c"] and [r["customer_id"] for r in summary["top_churn_risk_customers"]] == [3, 2, 1]
    assert [r["customer_id"] for r in json.loads(recommend.executive_report(rec).toJSON().first())["recommendations_top_20"]] == [1, 2, 3]
    outcomes = recommend.outcomes_report(rec, unit, 3)
    assert "top_3_actions" in outcomes.columns and [r["customer_id"] for r in json.loads(outcomes.toJSON().first())["top_3_actions"]] == [1, 2, 3]


def test_raw_csv_goes_through_all_layers(spark, tmp_path):
    """The first of equal keys wins by its place in the files, although tasks read parts of files in any order."""
    base, raw = f"file://{tmp_path}", tmp_path / "raw"
    (raw / "orders").mkdir(parents=True)
    for part, shift in (("a", 0), ("b", 1)):
        lines = ["order_id,customer_id,order_date,order_value"] + [f"O{(i + shift) % 3000},{i % 40},2025-01-{i % 28 + 1:02d},{i + 1}.5" for i in range(3000)]
        (raw / "orders" / f"{part}.csv").write_text("\n".join(lines) + "\nBAD,x7,2025-01-01,3\n")
    for name, text in (("customers", "customer_id,signup_date,channel,segment\n" + "".join(f"{i},{'2024-02-30' if i == 9 else '2024-01-05'},Organic,SMB\n" for i in range(40))), ("marketing", "channel,marketing_spend\nOrganic,100\n")):
        (raw / name).mkdir()
        (raw / name / "x.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        tables = files.read_raw(spark, f"{base}/raw")
        assert tables["orders"].rdd.getNumPartitions() > 4
        got = {r["order_id"]: float(r["order_value"]) for r in layers.silver_orders(tables["orders"], tables["customers"]).collect()}
        assert got == {f"O{i}": i + 1.5 for i in range(3000)}
        assert {r["_source_file"] for r in tables["orders"].select("_source_file").distinct().collect()} == {"a.csv", "b.csv"}
        assert [r["key"] for r in layers.rejects(tables["customers"], tables["orders"]).collect()] == ["x7", "x7"]
        assert layers.silver_customers(tables["customers"]).count() == 39
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_star_schema_tables_are_filled(spark, small):
    for name in warehouse.TABLES:
        spark.sql(f"DROP TABLE IF EXISTS default.{name}")
    for _ in range(2):
        warehouse.fill_tables(spark, warehouse.star_schema(*small))
    assert spark.table("fact_orders").count() == 2 and spark.table("dim_date").count() == 6
    assert spark.table("dim_customers").first()["city"] is None


def test_version_numbers_are_never_given_twice(spark, tmp_path):
    r = ml.Registry(spark, f"file://{tmp_path}/registry")
    assert [r.claimed("m"), r.claimed("m"), r.claimed("other")] == [1, 2, 1] and r.latest("m") is None


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from ledgerlight.functions import storage

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)


def test_discarded_tables_are_gone(spark):
    from ledgerlight.functions import storage

    one, two = storage.stored(spark.range(5)), storage.stored(spark.range(7))
    storage.discard(one)
    assert two.count() == 7
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST|not exist"):
        spark.read.parquet(one.stored_at).count()


def test_a_hot_value_is_ranked_without_a_join_on_it(spark, monkeypatch):
    from ledgerlight.functions import storage

    df = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(400)], "id long, v long")
    import pandas as pd

    want = pd.Series([0 if i % 3 else i for i in range(400)]).rank(pct=True).tolist()
    ranked = ranking.global_row_number(df, [F.col("v").asc(), F.col("id").asc()], "_rk")
    for most in (100_000, 0):
        monkeypatch.setattr(storage.beside, "__defaults__", ("beside", most))
        got = {r["id"]: r["p"] for r in ranking.percent_rank_average(ranked, "v", "p").collect()}
        assert [got[i] for i in range(400)] == pytest.approx(want)


def test_windows_of_a_growing_stream_equal_those_of_the_table(spark, tmp_path):
    path, out = f"file://{tmp_path}/requests", f"file://{tmp_path}/windows"
    log = fixtures.request_log(spark, D)
    for part in (0, 1):
        log.where(F.pmod(F.xxhash64("ts", "latency"), 2) == part).write.mode("append").parquet(path)
        jobs.metrics_table(jobs.table_stream(spark, path), out, lateness="10000 days")
    shown = lambda df: sorted((r["endpoint"], r["status"] or "", r["window_start"], r["requests"], round(r["mean_latency"], 6), r["last_latency"]) for r in df.collect())
    assert shown(jobs.latest_windows(spark, out)) == shown(jobs.request_metrics(log))
