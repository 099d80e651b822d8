"""The batch run: raw tables to layers, models, metrics, recommendations and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators import features, layers, metrics, ml, quality, recommend, warehouse
from ledgerlight.sources import files


#: Layers that Config.buckets cuts alike, so that customers meet their orders without a shuffle.
BUCKETED = ("silver/customers", "silver/orders", "gold/dim_customers", "gold/fact_orders")


@dataclass
class Config:
    root: str
    trees: int = ml.TREES
    depth: int = ml.DEPTH
    folds: int = ml.MOST_FOLDS
    refuse: tuple[str, ...] = ("repeated_keys",)  # of the gold tables; also null_keys, orphans
    database: str | None = None  # where the star schema's tables are filled, too
    buckets: int = 0  # of customers and orders by customer_id; as many as tasks that read them, 0 for plain files


def run(spark: SparkSession, raw: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """raw: customers, orders, marketing, with _row_seq, and _source_file where they were scanned from files (files.read_raw).

    Writes every layer under config.root and returns the published tables.
    """
    at, out = config.root.rstrip("/"), {}
    stamp = F.lit(spark.sql("SELECT current_timestamp()").first()[0])

    even = bool(config.buckets) and files.spreads(raw["orders"], "customer_id", config.buckets)  # else one customer's bucket is one long task

    def put(layer: str, name: str, df: DataFrame, month_of: str | None = None) -> DataFrame:
        if even and f"{layer}/{name}" in BUCKETED:
            return files.write_bucketed(df, f"{at}/{layer}/{name}", f"{config.database or 'default'}.{layer}_{name}", "customer_id", config.buckets, month_of)
        files.write_layer(df, f"{at}/{layer}/{name}", month_of)
        return spark.read.parquet(f"{at}/{layer}/{name}").drop("month_part")

    file = lambda n, df: F.col("_source_file") if "_source_file" in df.columns else n
    bronze = {n: put("bronze", n, layers.bronze(df, file(n, df), stamp)) for n, df in raw.items()}
    out["rejects"] = put("silver", "rejects", layers.rejects(bronze["customers"], bronze["orders"]))
    c = put("silver", "customers", layers.silver_customers(bronze["customers"]))
    o = put("silver", "orders", layers.silver_orders(bronze["orders"], bronze["customers"]), "order_date")
    m = put("silver", "marketing", layers.silver_marketing(bronze["marketing"]))
    seen = {}
    for name, df in warehouse.star_schema(c, o).items():
        df, seen[name] = quality.watched(df, name)
        out[name] = put("gold", name, df, "order_date" if name == "fact_orders" else None)
        out[name].createOrReplaceTempView(f"processed_{name}")  # published without a copy
    if config.database:
        warehouse.fill_tables(spark, out, config.database)
    if bad := quality.contract_report({n: out[n] for n in quality.REQUIRED}).where("not present").collect():
        raise ValueError(f"gold tables lack columns: {bad}")
    out["key_checks"] = put("gold", "key_checks", quality.sound(out, seen, config.refuse))
    f = put("processed", "customer_features", features.customer_features(c, o))
    options = {"trees": config.trees, "depth": config.depth, "folds": config.folds}
    trained = {"churn": ml.train(f, "churn", "is_churned", **options), "next_purchase_30d": ml.train(f, "next_purchase_30d", "next_purchase_30d", **options)}
    registry, version = ml.Registry(spark, f"{at}/registry"), ml.fingerprint(f).first()["data_version"]
    for name, target in (("churn", "is_churned"), ("next_purchase_30d", "next_purchase_30d")):
        registry.register(trained[name], version, target, ml.parameters(name, **options))
    out["scored_customers"] = put("processed", "scored_customers", ml.scored_customers(f, trained["churn"].model, trained["next_purchase_30d"].model))
    out["ltv"] = put("processed", "ltv", metrics.ltv(out["scored_customers"]))
    out["cac_by_channel"] = put("processed", "cac_by_channel", metrics.cac_by_channel(m, c))
    out["rfm_segments"] = put("processed", "rfm_segments", metrics.rfm_segments(o, c))
    out["cohort_retention"] = put("processed", "cohort_retention", metrics.cohort_retention(o, c))
    out["unit_economics"] = put("processed", "unit_economics", metrics.unit_economics(out["ltv"], out["cac_by_channel"]))
    out["recommendations"] = rec = put("processed", "recommendations", recommend.recommendations(out["ltv"], out["cac_by_channel"]))
    out["top_10_actions"] = put("processed", "top_10_actions", recommend.top_action_outcomes(rec))
    out["model_metrics"] = put("processed", "model_metrics", metrics_table(spark, trained))
    out["model_curves"] = put("processed", "model_curves", ml.curves(trained))
    files.write_report(recommend.executive_report(rec, out["model_metrics"]), f"{at}/reports/executive_report")
    files.write_report(recommend.executive_summary(rec, out["scored_customers"], out["unit_economics"]), f"{at}/reports/executive_summary")
    files.write_report(recommend.outcomes_report(rec, out["unit_economics"]), f"{at}/reports/business_outcomes")
    files.write_report(out["model_metrics"], f"{at}/reports/metrics_report")
    files.write_csv(out["top_10_actions"], f"{at}/export/top_10_actions")
    return out | {"customer_features": f, "silver_customers": c, "silver_orders": o, "silver_marketing": m}


def metrics_table(spark: SparkSession, trained: dict[str, ml.Trained]) -> DataFrame:
    columns = "model_name string, cv_roc_auc_mean double, cv_roc_auc_std double, holdout_roc_auc double, split_strategy string, train_size long, test_size long"
    return spark.createDataFrame([{"model_name": n, **t.metrics} for n, t in trained.items()], columns)
