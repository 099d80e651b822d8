"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import POLICIES
from ledgerlight.functions.storage import shared_dir, stored
from ledgerlight.operators import features, layers, metrics, ml, quality, recommend, warehouse
from ledgerlight.operators.ranking import stratified_folds, temporal_split
from ledgerlight.plans import oracles
from ledgerlight.plans.pipeline import metrics_table
from ledgerlight.sources import files
from ledgerlight.sources import fixtures as T
from ledgerlight.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
AS_OF = "2001-08-01"


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def gold(s, d):
    return warehouse.star_schema(T.customers(s, d), T.orders(s, d))


def feature_table(s, d):
    return features.customer_features(T.customers(s, d), T.orders(s, d))


def scored(s, d):
    """Fixed scores that SQL can express."""
    pick = lambda c, a, b: F.when(F.col(c) == 1, a).otherwise(b)
    return feature_table(s, d).withColumns({"churn_probability": pick("is_churned", 0.8, 0.2), "next_purchase_probability": pick("next_purchase_30d", 0.7, 0.3)})


def cac(s, d):
    return metrics.cac_by_channel(T.marketing(s, d), T.customers(s, d))


def rec(s, d):
    return recommend.recommendations(metrics.ltv(scored(s, d)), cac(s, d))


def unit(s, d):
    return metrics.unit_economics(metrics.ltv(scored(s, d)), cac(s, d))


@query
def revenue_kpis(s, d):
    o = T.orders(s, d)
    return warehouse.revenue_kpis(warehouse.order_facts(o), warehouse.dim_date(o))


@query
def channel_efficiency(s, d):
    g = gold(s, d)
    return warehouse.channel_efficiency(g["fact_orders"], g["dim_channel"])


@query
def churn_watchlist(s, d):
    return warehouse.churn_watchlist(warehouse.dim_customers(T.customers(s, d)), warehouse.order_facts(T.orders(s, d)), AS_OF)


#: Buckets of the queries below.
BUCKETS = 8


def bucketed(s, name, df, month_of=None):
    path = jobs.new_folder(s, name)
    return files.write_bucketed(df, path, path.rsplit("/", 1)[1].replace("-", "_"), "customer_id", BUCKETS, month_of)


@query
def churn_watchlist_bucketed(s, d):
    """Over gold tables written in like buckets: no exchange before the last sort."""
    dims = bucketed(s, "dim_customers", warehouse.dim_customers(T.customers(s, d)))
    return warehouse.churn_watchlist(dims, bucketed(s, "order_facts", warehouse.order_facts(T.orders(s, d)), "order_date"), AS_OF)


@query
def customer_features_bucketed(s, d):
    """Over silver tables written in like buckets: orders are not shuffled."""
    return features.customer_features(bucketed(s, "customers", T.customers(s, d)), bucketed(s, "orders", T.orders(s, d), "order_date"))


@query
def customer_summary_ingest(s, d):
    c = layers.customers_from_summary(T.customer_summary(s, d))
    return c.select("customer_id", "membership_type", "segment", "channel", "signup_date", "recency_days")


@query
def marketing_from_customers(s, d):
    return layers.marketing_from_customers(T.customers(s, d))


@query
def bronze_orders(s, d):
    return layers.bronze(T.dirty_orders(s, d), "orders.parquet", F.current_timestamp()).drop("_ingestion_ts")


@query
def silver_customers(s, d):
    return layers.silver_customers(T.dirty_customers(s, d))


@query
def silver_orders(s, d):
    return layers.silver_orders(T.dirty_orders(s, d), T.dirty_customers(s, d))


@query
def silver_marketing(s, d):
    return layers.silver_marketing(T.dirty_marketing(s, d))


@query
def silver_customers_text(s, d):
    """Sign-up dates as text, some of them no dates: those rows go, and nothing fails."""
    return layers.silver_customers(T.customers_with_text_dates(s, d))


@query
def silver_rejects(s, d):
    """Bronze rows whose customer id is no number."""
    return layers.rejects(T.with_bad_ids(T.dirty_customers(s, d)), T.with_bad_ids(T.dirty_orders(s, d))).select("table_name", "key")


def landed_summary(s, d):
    path = jobs.new_folder(s, "raw-summary")
    files.land_raw({"summary": T.broken_summary(s, d)}, path)
    return files.summary_parts(s, f"{path}/summary")


@query
def summary_rejects(s, d):
    """Every row of a landed summary: accepted, or rejected with its line and file."""
    rows, rejects = landed_summary(s, d)
    of_csv = F.col("_source_file").rlike(r"\.csv$") & (F.col("_row_seq.at") >= 0)
    first = F.split("line", ",")[0].cast("int")
    return rows.select(F.col("`Customer ID`").alias("customer_id"), F.lit("accepted").alias("outcome"), F.lit(None).cast("boolean").alias("line_kept"), of_csv.alias("has_place")).unionByName(
        rejects.select(first.alias("customer_id"), F.lit("rejected").alias("outcome"), F.col("line").rlike("n/a, unknown|1\\.5\\.2").alias("line_kept"), of_csv.alias("has_place"))
    )


@query
def summary_csv_ingest(s, d):
    """Customers from the rows of the landed summary that parse."""
    c = layers.customers_from_summary(landed_summary(s, d)[0].withColumns({"Channel": F.lit(None).cast("string"), "Signup Date": F.lit(None).cast("date")}))
    return c.select("customer_id", "membership_type", "segment", "recency_days")


def landed_csv(s, d):
    """The dirty raw tables as CSV files, in source order, and read back with file names and row places."""
    path = jobs.new_folder(s, "raw")
    raw = {"customers": T.dirty_customers(s, d), "orders": T.dirty_orders(s, d), "marketing": T.dirty_marketing(s, d)}
    files.land_raw({n: df.orderBy("_row_seq").drop("_row_seq") for n, df in raw.items()}, path)
    return files.read_raw(s, path)


@query
def bronze_csv_orders(s, d):
    b = layers.bronze(landed_csv(s, d)["orders"], F.col("_source_file"), F.current_timestamp())
    return b.select("order_id", "customer_id", "order_date", "order_value", F.col("_source_file").rlike(r"^part-.*\.csv$").alias("from_csv"))


@query
def silver_csv_orders(s, d):
    """By the rows' places in the files, the first of equal keys wins as in the source."""
    raw = landed_csv(s, d)
    return layers.silver_orders(raw["orders"], raw["customers"])


@query
def silver_stream_orders(s, d):
    """Silver over what two runs of the stream landed."""
    raw, out = jobs.new_folder(s, "raw-stream"), jobs.new_folder(s, "bronze")
    o = T.dirty_orders(s, d)
    for part in ("_row_seq % 4 < 2", "_row_seq % 4 >= 2"):  # all copies of an order come in one run
        o.where(part).orderBy("_row_seq").drop("_row_seq").write.mode("append").parquet(raw)
        jobs.landed(jobs.table_stream(s, raw), out)
    return layers.silver_orders(s.read.parquet(out).drop("batch"), T.dirty_customers(s, d))


for _name in ("dim_date", "dim_channel", "dim_customers", "fact_orders"):
    REGISTRY[_name] = lambda s, d, name=_name: gold(s, d)[name]


@query
def customer_features(s, d):
    return feature_table(s, d)


@query
def ltv(s, d):
    return metrics.ltv(feature_table(s, d)).select("customer_id", "channel", "segment", "arpu", "churn_probability", "expected_retention_months", "ltv")


@query
def cac_by_channel(s, d):
    return cac(s, d)


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def unit_economics(s, d):
    return six(unit(s, d), "avg_arpu", "ltv_cac_ratio", "contribution_margin", "payback_period_months")


@query
def rfm_segments(s, d):
    return metrics.rfm_segments(T.orders(s, d), T.customers(s, d))


@query
def cohort_retention(s, d):
    return metrics.cohort_retention(T.orders(s, d), T.customers(s, d))


@query
def cohort_matrix(s, d):
    return metrics.cohort_matrix(stored(cohort_retention(s, d), "cohorts"))


@query
def cohort_matrix_cells(s, d):
    """The matrix in long form."""
    return metrics.cohort_cells(cohort_retention(s, d))


@query
def recommendations(s, d):
    return rec(s, d)


@query
def executive_kpis(s, d):
    return recommend.executive_kpis(rec(s, d))


@query
def summary_kpis(s, d):
    return recommend.summary_kpis(rec(s, d), scored(s, d))


@query
def top_churn_risk(s, d):
    return recommend.top_churn_risk(rec(s, d))


@query
def top_actions(s, d):
    return recommend.top_actions(rec(s, d))


@query
def channel_ranking(s, d):
    return six(recommend.channel_ranking(unit(s, d)), "ltv_cac_ratio")


@query
def summary_report_sections(s, d):
    """The arrays of the summary report, one row for each entry: channels, risks, actions."""
    r = recommend.executive_summary(rec(s, d), scored(s, d), unit(s, d))
    entry = lambda name, key, value: r.select(F.lit(name).alias("section"), F.posexplode(name).alias("place", "e")).select("section", "place", F.col(f"e.{key}").cast("string").alias("key"), F.round(f"e.{value}", 6).alias("value"))
    parts = [entry("ltv_cac_by_channel", "channel", "ltv_cac_ratio"), entry("top_churn_risk_customers", "customer_id", "churn_probability"), entry("top_20_recommended_actions", "customer_id", "strategic_score")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def outcomes_report_sections(s, d):
    """The outcomes report: KPIs, totals, assumptions and channels as keys and values."""
    r = recommend.outcomes_report(stored(rec(s, d), "rec"), unit(s, d))
    one = lambda section, keys: F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"), F.round(F.col(f"{section}.{k}"), 6).alias("value")) for k in keys])
    assumed = F.array(*[F.struct(F.lit("simulation_assumptions").alias("section"), F.lit(f"{a} {k}").alias("key"), F.col("simulation_assumptions")[a][k].alias("value")) for a in POLICIES for k in ("uplift_rate", "cost_rate")])
    channels = F.transform("ltv_cac_by_channel", lambda e: F.struct(F.lit("ltv_cac_by_channel").alias("section"), e["channel"].alias("key"), F.round(e["ltv_cac_ratio"], 6).alias("value")))
    actions = F.transform("top_10_actions", lambda e: F.struct(F.lit("top_10_actions").alias("section"), F.concat(e["priority_rank"], F.lit(" "), e["action"]).alias("key"), F.round(e["net_impact"], 6).alias("value")))
    parts = F.concat(one("kpis", ["avg_ltv_cac_ratio", "high_churn_risk_pct", "simulated_net_impact_top10"]), one("simulation_summary_top10", ["total_action_cost", "delta_revenue_90d", "roi_simulated"]), assumed, channels, actions)
    return r.select(F.explode(parts).alias("e")).select("e.section", "e.key", "e.value")


@query
def executive_report_top(s, d):
    """The first recommendations of the executive report, in their order."""
    r = recommend.executive_report(rec(s, d))
    return r.select(F.posexplode("recommendations_top_20").alias("place", "e"), "base_size.customers_in_scope").select("place", "customers_in_scope", "e.*")


@query
def top_10_actions(s, d):
    return recommend.top_action_outcomes(rec(s, d))


@query
def business_outcomes(s, d):
    return recommend.business_outcomes(stored(rec(s, d), "rec"))


@query
def portfolio_slice_kpis(s, d):
    return recommend.slice_kpis(recommend.sliced(rec(s, d), segment="SMB"))


@query
def action_mix(s, d):
    return recommend.action_mix(rec(s, d))


@query
def segment_risk(s, d):
    return recommend.mean_by(rec(s, d), "segment", "churn_probability", "avg_risk")


@query
def channel_next_purchase(s, d):
    return recommend.mean_by(rec(s, d), "channel", "next_purchase_probability", "avg_next_purchase")


@query
def action_board(s, d):
    return recommend.action_board(recommend.sliced(rec(s, d)))


@query
def action_board_by_score(s, d):
    """The board under its earlier name."""
    return action_board(s, d)


@query
def portfolio_leaders(s, d):
    return recommend.portfolio_leaders(stored(recommend.sliced(rec(s, d)), "board"))


@query
def slicer_values(s, d):
    v = recommend.slicer_values(rec(s, d))
    return v.select(*[F.array_join(c, "|").alias(c) for c in v.columns])


@query
def gold_contract_report(s, d):
    return quality.contract_report(gold(s, d))


@query
def key_checks(s, d):
    return quality.key_checks(gold(s, d))


@query
def referential_checks(s, d):
    g = warehouse.star_schema(silver_customers(s, d), stored(silver_orders(s, d), "silver"))
    return quality.referential_checks(g).withColumn("table_name", F.lit("silver_fact"))


@query
def retention_range(s, d):
    return quality.out_of_range(cohort_retention(s, d), "retention_rate", 0, 1)


def records(s, d):
    f = feature_table(s, d)
    key = F.col("customer_id")
    return f.select(
        key.alias("record_id"), "recency_days", "frequency", F.when(key % 67 == 0, -F.col("monetary") - 1).otherwise(F.col("monetary")).alias("monetary"), "avg_order_value", "tenure_days",
        "arpu", F.when(key % 71 == 0, "").otherwise(F.col("channel")).alias("channel"), "segment",
    )


@query
def score_record_validation(s, d):
    return quality.validated_records(records(s, d)).select("record_id", F.array_join("_errors", ",").alias("errors"))


@query
def temporal_split_80(s, d):
    return temporal_split(feature_table(s, d).where("is_churned is not null"), "signup_date", "customer_id").select("customer_id", "split")


@query
def stratified_fold_sizes(s, d):
    return stratified_folds_5(s, d).groupBy("is_churned", "fold").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_folds_5(s, d):
    return stratified_folds(feature_table(s, d).where("is_churned is not null"), "is_churned", "customer_id", 5).select("customer_id", "is_churned", "fold")


@query
def roc_points(s, d):
    f = feature_table(s, d).where("is_churned is not null")
    return ml.roc_points(f.select((F.floor(F.col("recency_days") / 7) * 7).cast("int").alias("score"), F.col("is_churned").alias("label")))


TARGETS = {"churn": "is_churned", "next_purchase_30d": "next_purchase_30d"}


def models(s, f, folds=0):
    return [ml.train(f, name, target, folds=folds) for name, target in TARGETS.items()]


def registered_model(s, f, name):
    """The model in the registry for this state of the features and these parameters, and its version; trained and registered where there is none."""
    r, version, own = ml.Registry(s, f"{shared_dir(s)}/registry"), ml.fingerprint(f).first()["data_version"], ml.parameters(name, folds=0)
    try:
        model, entry = r.load(name, version, own)
    except FileNotFoundError:
        trained = ml.train(f, name, TARGETS[name], folds=0)
        model, entry = trained.model, r.register(trained, version, TARGETS[name], own)
    return model, entry["model_version"]


def registered_models(s, f):
    """Both models, and their versions by name."""
    found = {name: registered_model(s, f, name) for name in TARGETS}
    return [m for m, _ in found.values()], {name: v for name, (_, v) in found.items()}


@query
def churn_scores(s, d):
    f = stored(feature_table(s, d), "features")
    return ml.scores(registered_model(s, f, "churn")[0], f, "churn_probability").select("customer_id", "churn_probability")


@query
def next_purchase_scores(s, d):
    f = stored(feature_table(s, d), "features")
    return ml.scores(registered_model(s, f, "next_purchase_30d")[0], f, "next_purchase_probability").select("customer_id", "next_purchase_probability")


@query
def model_split_sizes(s, d):
    """How the evaluation splits the labelled rows; both sides have both classes here, so the split is the temporal one."""
    f, parts = stored(feature_table(s, d), "features"), []
    for name, target in TARGETS.items():
        split, strategy = ml.evaluation_split(ml.labelled(f, target))
        parts.append(split.agg(F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size")).select(F.lit(name).alias("model_name"), F.lit(strategy).alias("split_strategy"), "train_size", "test_size"))
    return parts[0].unionByName(parts[1])


@query
def model_metrics(s, d):
    f = stored(feature_table(s, d), "features")
    churn, following = models(s, f, folds=ml.MOST_FOLDS)
    return metrics_table(s, {"churn": churn, "next_purchase_30d": following})


@query
def batch_scores(s, d):
    (churn, following), versions = registered_models(s, stored(feature_table(s, d), "features"))
    return ml.batch_scores(records(s, d), churn, following, versions)


@query
def batch_score_outcomes(s, d):
    """Which records were scored, with probabilities and an action that are in range, and which were rejected."""
    done = batch_scores(s, d)
    fine = F.col("churn_probability").between(0, 1) & F.col("next_purchase_probability").between(0, 1) & F.col("suggested_action").isin(list(POLICIES)) & (F.size("model_versions") == 2)
    return done.select("record_id", F.when(fine, "scored").otherwise("out of range").alias("outcome")).unionByName(quality.rejected(records(s, d)).select("record_id", F.lit("rejected").alias("outcome")))


def fixed_roc(s, d):
    return stored(roc_points(s, d), "roc")


@query
def roc_hull(s, d):
    return ml.roc_hull(fixed_roc(s, d))


@query
def roc_curve_areas(s, d):
    """The area of the whole curve, of its hull, and of 11 points at most; and whether each has no more points than it may."""
    points = fixed_roc(s, d)
    n, parts = points.count(), []
    for name, curve, most in (("full", points, n), ("hull", ml.roc_hull(points), n), ("thinned", ml.roc_thinned(points, 11), 11)):
        curve = stored(curve.select("fpr", "tpr"), name)
        parts.append(ml.curve_area(curve).select(F.lit(name).alias("curve"), F.lit(curve.count() <= most).alias("within"), F.round("area", 9).alias("area")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def model_curves(s, d):
    """Curves of the registered models over all labelled rows, of 200 points at most each; the batch run writes those of the test sides."""
    f, parts = stored(feature_table(s, d), "features"), []
    for name, target in TARGETS.items():
        rows = ml.scores(registered_model(s, f, name)[0], ml.labelled(f, target), "score")
        thin = ml.roc_thinned(ml.roc_hull(stored(ml.roc_points(rows), "roc")), 200)
        parts.append(thin.select(F.lit(name).alias("model_name"), "threshold", "fpr", "tpr"))
    return parts[0].unionByName(parts[1])


@query
def dataset_fingerprint(s, d):
    return ml.fingerprint(feature_table(s, d))


@query
def fingerprint_checks(s, d):
    """Rows, and whether the fingerprint stays when rows are dealt anew and changes when one goes."""
    f = stored(feature_table(s, d), "features")
    version = lambda df: ml.fingerprint(df).first()["data_version"]
    own = version(f)
    fewer = version(f.where(F.col("customer_id") != f.agg(F.max("customer_id")).first()[0]))
    return f.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(own == version(f.repartition(7))).alias("same_rows"), F.lit(own != fewer).alias("changed_rows"))


@query
def bronze_stream(s, d):
    out = jobs.new_folder(s, "bronze")
    o = T.orders(s, d)
    jobs.landed(jobs.table_stream(s, written(s, o, "raw-orders")), out)
    return s.read.parquet(out).select("order_id", "customer_id", "order_date", "order_value")


def written(s, df, name):
    path = jobs.new_folder(s, name)
    df.write.parquet(path)
    return path


def streamed_scores(s, d):
    (churn, following), versions = registered_models(s, stored(feature_table(s, d), "features"))
    out = jobs.new_folder(s, "scored")
    jobs.scored_stream(jobs.table_stream(s, written(s, records(s, d), "records")), churn, following, versions, out)
    return out


@query
def stream_score_outcomes(s, d):
    """What the stream put into its two sinks."""
    out = streamed_scores(s, d)
    parts = [s.read.parquet(f"{out}/{sink}").select("record_id", F.lit(name).alias("outcome")) for sink, name in (("predictions", "scored"), ("rejects", "rejected"))]
    return parts[0].unionByName(parts[1])


@query
def stream_scores(s, d):
    out = streamed_scores(s, d)
    return s.read.parquet(f"{out}/predictions").drop("batch").select("record_id", "churn_probability", "next_purchase_probability", "suggested_action")


@query
def request_metrics(s, d):
    out = jobs.new_folder(s, "metrics")
    jobs.metrics_table(jobs.table_stream(s, written(s, T.request_log(s, d), "requests")), out)
    m = jobs.latest_windows(s, out)
    return m.select("endpoint", "status", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", F.round("mean_latency", 6).alias("mean_latency"), "last_latency")


@query
def model_version_usage(s, d):
    """Predictions by model and hour over a stream of records that came in two runs; here each model has one version."""
    (churn, following), versions = registered_models(s, stored(feature_table(s, d), "features"))
    raw, out, usage = (jobs.new_folder(s, n) for n in ("raw-records", "scored", "usage"))
    r = records(s, d).withColumn("scored_at", F.expr("timestamp'2001-08-01 00:00:00' + make_dt_interval(0, 0, cast(record_id % 2880 as int), 0)"))
    for part in ("record_id % 2880 < 1440", "record_id % 2880 >= 1440"):
        r.where(part).write.mode("append").parquet(raw)
        jobs.scored_stream(jobs.table_stream(s, raw), churn, following, versions, out)
        jobs.usage_table(jobs.table_stream(s, f"{out}/predictions"), usage)
    rows = jobs.latest_windows(s, usage, ("model", "model_version", "window_start"))
    hour = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.groupBy("model", hour).agg(F.sum("predictions").alias("predictions"), F.countDistinct("model_version").alias("versions"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
