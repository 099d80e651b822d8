"""Next best actions, and the reports that rank, total and slice them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import POLICIES, action_cost, expected_uplift, ranked_action
from ledgerlight.functions.storage import beside
from ledgerlight.operators.ranking import exact_quantiles, global_row_number, percent_rank_average

#: The columns of a recommendation.
COLUMNS = ["customer_id", "channel", "segment", "ltv", "cac", "ltv_cac_ratio", "churn_probability", "next_purchase_probability", "strategic_score", "recommended_action"]


def recommendations(values: DataFrame, cac: DataFrame) -> DataFrame:
    c = values.join(beside(cac.select("channel", "cac")), "channel", "left").na.fill(0.0, ["cac"])
    c = c.withColumn("ltv_cac_ratio", F.col("ltv") / F.when(F.col("cac") == 0, 1.0).otherwise(F.col("cac")))
    ranked = global_row_number(c, [F.col("ltv").asc(), F.col("customer_id").asc()], "_rk")
    limits = exact_quantiles(ranked, "ltv", {"q30": 0.3, "q70": 0.7})
    usual = ranked.agg(F.median("cac").alias("median_cac"))  # the aggregate keeps one entry for each channel's cost
    c = percent_rank_average(ranked, "ltv", "pct").crossJoin(F.broadcast(limits)).crossJoin(F.broadcast(usual))
    churn, following = F.col("churn_probability"), F.col("next_purchase_probability")
    c = c.withColumns({
        "recommended_action": ranked_action(churn, F.col("ltv"), F.col("cac"), F.col("q70"), F.col("q30"), F.col("median_cac")),
        "strategic_score": F.lit(0.45) * F.col("pct") + F.lit(0.35) * (1 - churn) + F.lit(0.2) * following,
    })
    return c.select(*COLUMNS).orderBy(F.col("strategic_score").desc_nulls_last(), "customer_id")


def executive_kpis(rec: DataFrame) -> DataFrame:
    means = {"avg_ltv": "ltv", "avg_cac": "cac", "avg_ltv_cac_ratio": "ltv_cac_ratio", "avg_churn_probability": "churn_probability", "avg_next_purchase_probability": "next_purchase_probability"}
    return rec.agg(
        F.countDistinct("customer_id").alias("customers_in_scope"), F.count(F.lit(1)).alias("rows_in_recommendation_table"), *[F.round(F.avg(c), 6).alias(n) for n, c in means.items()]
    )


def top_by(rec: DataFrame, column: str, n: int, columns: list[str]) -> DataFrame:
    return rec.orderBy(F.col(column).desc_nulls_last(), "customer_id").limit(n).select(*columns)


def top_churn_risk(rec: DataFrame, n: int = 20) -> DataFrame:
    return top_by(rec, "churn_probability", n, ["customer_id", "segment", "channel", "churn_probability"])


def top_actions(rec: DataFrame, n: int = 20) -> DataFrame:
    return top_by(rec, "strategic_score", n, ["customer_id", "recommended_action", "strategic_score", "ltv_cac_ratio"])


def channel_ranking(unit: DataFrame) -> DataFrame:
    return unit.select("channel", "ltv_cac_ratio").orderBy(F.desc("ltv_cac_ratio"), "channel")


def summary_kpis(rec: DataFrame, scored: DataFrame) -> DataFrame:
    a = scored.agg(F.round(F.sum("monetary"), 2).alias("total_revenue_proxy"), F.round(F.avg("arpu"), 6).alias("avg_arpu"))
    return a.crossJoin(rec.agg(F.round(F.avg("churn_probability"), 6).alias("avg_churn_probability")))


def simulated(rec: DataFrame) -> DataFrame:
    args = [F.col(c) for c in ("recommended_action", "ltv", "cac", "churn_probability", "next_purchase_probability")]
    r = rec.withColumns({"expected_uplift": expected_uplift(*args), "action_cost": action_cost(*args[:3])})
    r = r.withColumn("net_impact", F.col("expected_uplift") - F.col("action_cost"))
    baseline = F.col("ltv") * F.col("next_purchase_probability")
    return r.withColumns({
        "roi_simulated": F.when(F.col("action_cost") > 0, F.try_divide(F.col("net_impact"), F.col("action_cost"))).otherwise(0.0),
        "baseline_revenue_90d": baseline,
        "scenario_revenue_90d": baseline + F.col("expected_uplift"),
    })


def top_action_outcomes(rec: DataFrame, n: int = 10) -> DataFrame:
    """The first n actions with what they would bring; n bounds the one task that numbers them."""
    from pyspark.sql import Window as W

    order = [F.col("strategic_score").desc_nulls_last(), F.col("customer_id")]
    top = simulated(rec.orderBy(*order).limit(n)).withColumn("priority_rank", F.row_number().over(W.orderBy(*order)))
    return top.select(
        "priority_rank", "customer_id", "channel", "segment", F.col("recommended_action").alias("action"), F.col("strategic_score").alias("strategic_priority_score"),
        "expected_uplift", "action_cost", "net_impact", "roi_simulated", "baseline_revenue_90d", "scenario_revenue_90d", "ltv_cac_ratio",
    )


def business_outcomes(rec: DataFrame, n: int = 10) -> DataFrame:
    t = top_action_outcomes(rec, n).agg(
        *[F.sum(c).alias(a) for c, a in (("baseline_revenue_90d", "b"), ("scenario_revenue_90d", "s"), ("action_cost", "c"), ("net_impact", "n"))]
    )
    all_ = rec.agg(F.avg("ltv_cac_ratio").alias("avg_ltv_cac_ratio"), F.avg((F.col("churn_probability") >= 0.7).cast("double")).alias("high_churn_risk_pct"))
    r = lambda c: F.round(c, 6)
    return all_.crossJoin(t).select(
        r(F.col("avg_ltv_cac_ratio")).alias("avg_ltv_cac_ratio"), r(F.col("high_churn_risk_pct")).alias("high_churn_risk_pct"), r(F.col("b")).alias("baseline_revenue_90d"),
        r(F.col("s")).alias("scenario_revenue_90d"), r(F.col("s") - F.col("b")).alias("delta_revenue_90d"), r(F.col("c")).alias("total_action_cost"), r(F.col("n")).alias("net_impact"),
        r(F.when(F.col("c") > 0, F.try_divide(F.col("n"), F.col("c"))).otherwise(0.0)).alias("roi_simulated"),
    )


def listed(df: DataFrame, columns: list[str], by: str, name: str) -> DataFrame:
    """One row with the few rows of df as an array, highest first, ties by the first column."""
    place = F.struct(F.col(by).isNull().alias("none"), (-F.col(by)).alias("by"), F.col(columns[0]).alias("tie"))
    rows = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*columns).alias("row"))))
    return df.agg(F.transform(rows, lambda r: r["row"]).alias(name))


def dated(*sections: DataFrame) -> DataFrame:
    """The one-row sections side by side, behind the time of the refresh."""
    out = sections[0]
    for s in sections[1:]:
        out = out.crossJoin(s)
    return out.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("data_refresh_utc"), "*")


def section(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    return df.select(F.struct(*(columns or df.columns)).alias(name))


SIZES = ["customers_in_scope", "rows_in_recommendation_table"]


def executive_report(rec: DataFrame, model_metrics: DataFrame | None = None, n: int = 20) -> DataFrame:
    """One row of sections, ready for write.json: sizes, KPIs, the models' metrics, the first n recommendations."""
    k = executive_kpis(rec)
    parts = [k.select(F.struct(*SIZES).alias("base_size"), F.struct(*[c for c in k.columns if c not in SIZES]).alias("top_kpis"))]
    if model_metrics is not None:
        names = ["split_strategy", "cv_roc_auc_mean", "holdout_roc_auc", "train_size", "test_size"]
        by_model = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", F.struct(*names).alias("metrics")))))
        parts.append(model_metrics.agg(by_model.alias("model_performance")))
    return dated(*parts, listed(top_by(rec, "strategic_score", n, COLUMNS), COLUMNS, "strategic_score", f"recommendations_top_{n}"))


def executive_summary(rec: DataFrame, scored: DataFrame, unit: DataFrame, n: int = 20) -> DataFrame:
    """One row of sections: KPIs, channels by LTV/CAC, the n customers of the highest risk, the first n actions."""
    risk, actions = top_churn_risk(rec, n), top_actions(rec, n)
    return dated(
        section(summary_kpis(rec, scored), "kpis"),
        listed(channel_ranking(unit), ["channel", "ltv_cac_ratio"], "ltv_cac_ratio", "ltv_cac_by_channel"),
        listed(risk, risk.columns, "churn_probability", "top_churn_risk_customers"),
        listed(actions, actions.columns, "strategic_score", f"top_{n}_recommended_actions"),
    )


def outcomes_report(rec: DataFrame, unit: DataFrame, n: int = 10) -> DataFrame:
    """One row of sections: KPIs, channels by LTV/CAC, the policies assumed, totals over the first n actions, and these."""
    out = business_outcomes(rec, n)
    totals = ["baseline_revenue_90d", "scenario_revenue_90d", "delta_revenue_90d", "total_action_cost", "net_impact", "roi_simulated"]
    kpis = F.struct("avg_ltv_cac_ratio", "high_churn_risk_pct", F.col("net_impact").alias(f"simulated_net_impact_top{n}"))
    assumed = [F.struct(F.lit(up).alias("uplift_rate"), F.lit(cost).alias("cost_rate"), F.lit(base).alias("base")).alias(action) for action, (up, cost, base) in POLICIES.items()]
    top = top_action_outcomes(rec, n)
    top = top.withColumn("_order", -F.col("priority_rank"))
    return dated(
        out.select(kpis.alias("kpis"), F.struct(*assumed).alias("simulation_assumptions"), F.struct(*totals).alias(f"simulation_summary_top{n}")),
        listed(channel_ranking(unit), ["channel", "ltv_cac_ratio"], "ltv_cac_ratio", "ltv_cac_by_channel"),
        listed(top, [c for c in top.columns if c != "_order"], "_order", f"top_{n}_actions"),
    )


def sliced(rec: DataFrame, segment: str | None = None, channel: str | None = None, action: str | None = None) -> DataFrame:
    """The recommendations that all given selections allow, with their potential impact."""
    for column, value in (("segment", segment), ("channel", channel), ("recommended_action", action)):
        if value is not None:
            rec = rec.where(F.col(column) == value)
    return simulated(rec).withColumn("potential_impact", F.col("expected_uplift")).select(*COLUMNS, "potential_impact")


def slice_kpis(part: DataFrame) -> DataFrame:
    return part.agg(
        F.countDistinct("customer_id").alias("customers"), F.round(F.avg("ltv"), 6).alias("avg_ltv"), F.round(F.avg("churn_probability"), 6).alias("avg_risk"),
        F.round(F.avg("ltv_cac_ratio"), 6).alias("avg_efficiency"), F.round(F.sum("potential_impact"), 4).alias("total_impact"),
    )


def action_mix(part: DataFrame) -> DataFrame:
    n = part.where("recommended_action is not null").groupBy(F.col("recommended_action").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("action", "n", F.bround(F.col("n") / F.col("total") * 100, 1).alias("pct"))


def mean_by(part: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return part.where(F.col(key).isNotNull()).groupBy(key).agg(F.round(F.avg(column), 6).alias(name))


def action_board(part: DataFrame, n: int = 120) -> DataFrame:
    return part.orderBy(F.col("strategic_score").desc_nulls_last(), "customer_id").limit(n)


def portfolio_leaders(part: DataFrame) -> DataFrame:
    """One row: the customer of the highest potential impact, the riskiest segment, the commonest action; ties go to what is first in order."""
    first = lambda df, key, by: df.orderBy(F.col(by).desc_nulls_last(), key).limit(1)
    customer = part.where("potential_impact is not null").agg(
        F.max_by("customer_id", F.struct("potential_impact", -F.col("customer_id"))).alias("top_customer"), F.round(F.max("potential_impact"), 6).alias("top_impact")
    )
    segment = first(mean_by(part, "segment", "churn_probability", "avg_risk"), "segment", "avg_risk").select(F.col("segment").alias("riskiest_segment"), "avg_risk")
    action = first(action_mix(part), "action", "n").select(F.col("action").alias("top_action"), F.col("pct").alias("action_pct"))
    return customer.crossJoin(segment).crossJoin(action)


def slicer_values(rec: DataFrame) -> DataFrame:
    names = {"segments": "segment", "channels": "channel", "actions": "recommended_action"}
    return rec.agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in names.items()])
