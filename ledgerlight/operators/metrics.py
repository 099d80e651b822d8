"""Lifetime value, acquisition cost, RFM segments, cohorts and unit economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import GROSS_MARGIN, clamp, lifetime_value, months_between_months, retention_months, year_month
from ledgerlight.functions.storage import beside, stored
from ledgerlight.operators.ranking import several_quartiles


def ltv(scored: DataFrame, margin: float = GROSS_MARGIN) -> DataFrame:
    """Without a churn score: 0.8 for a churned customer, else 0.2."""
    if "churn_probability" not in scored.columns:
        scored = scored.withColumn("churn_probability", F.when(F.col("is_churned") == 1, 0.8).otherwise(0.2))
    churn = F.col("churn_probability")
    return scored.withColumns({"expected_retention_months": retention_months(churn), "ltv": lifetime_value(F.col("arpu"), churn, margin)})


def cac_by_channel(marketing: DataFrame, customers: DataFrame) -> DataFrame:
    n = customers.where("channel is not null").groupBy("channel").agg(F.count("customer_id").alias("customers_acquired"))
    m = marketing.select("channel", "marketing_spend").join(beside(n), "channel", "left").na.fill(1, ["customers_acquired"])
    return m.withColumn("cac", F.col("marketing_spend") / F.greatest("customers_acquired", F.lit(1)))


def rfm_segments(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Quartile scores; customers without orders count as 0 in all three, which is the best recency."""
    ref = orders.agg(F.date_add(F.max("order_date"), 1).alias("ref"))
    g = orders.groupBy("customer_id").agg(F.max("order_date").alias("last"), F.count("order_id").alias("frequency"), F.sum("order_value").alias("monetary"))
    c = customers.select("customer_id", "channel").join(g, "customer_id", "left").crossJoin(F.broadcast(ref))
    c = c.select(
        "customer_id", "channel", F.coalesce(F.datediff("ref", "last"), F.lit(0)).alias("recency"), F.coalesce("frequency", F.lit(0)).alias("frequency"),
        F.coalesce(F.col("monetary"), F.lit(0).cast("decimal(22,2)")).alias("monetary"),
    )
    c = stored(c, "rfm")
    c = several_quartiles(c, {"recency": "r_score", "frequency": "f_score", "monetary": "m_score"}, "customer_id")
    c = c.withColumn("r_score", 5 - F.col("r_score"))
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    label = F.when(total >= 10, "VIP").when(total >= 8, "Loyal").when(F.col("r_score") <= 2, "At Risk").otherwise("Hibernating")
    return c.withColumns({"monetary": F.col("monetary").cast("double"), "rfm_total": total, "segment": label})


def cohort_retention(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of each sign-up month's customers that buy in the months after; orders of unknown customers take no part."""
    c = customers.where("signup_date is not null").select("customer_id", "signup_date", year_month(F.col("signup_date")).alias("cohort_month"))
    size = c.groupBy("cohort_month").agg(F.countDistinct("customer_id").alias("cohort_size"))
    o = orders.select("customer_id", "order_date").join(c, "customer_id")
    o = o.withColumn("cohort_index", months_between_months(F.col("order_date"), F.col("signup_date")))
    active = o.groupBy("cohort_month", "cohort_index").agg(F.countDistinct("customer_id").alias("active_customers"))
    out = active.join(beside(size), "cohort_month", "left")
    rate = clamp(F.col("active_customers") / F.greatest("cohort_size", F.lit(1)), 0.0, 1.0)
    return out.select("cohort_month", "cohort_index", "active_customers", "cohort_size", rate.alias("retention_rate")).orderBy("cohort_month", "cohort_index")


def cohort_matrix(cohorts: DataFrame) -> DataFrame:
    """One row for each cohort, its retention in percent by month index; the span of months in the data bounds the columns."""
    indexes = [r[0] for r in cohorts.select("cohort_index").distinct().orderBy("cohort_index").collect()]
    wide = cohorts.withColumn("pct", F.col("retention_rate") * 100).groupBy("cohort_month").pivot("cohort_index", indexes).agg(F.first("pct"))
    return wide.select("cohort_month", *[F.col(f"`{i}`").alias(f"m{i}".replace("-", "_")) for i in indexes])


def cohort_cells(cohorts: DataFrame) -> DataFrame:
    """The matrix in long form, with every month index that there is: cohort_month, cohort_index, retention_pct."""
    return cohorts.select("cohort_month", "cohort_index", (F.col("retention_rate") * 100).alias("retention_pct"))


def zero_if_undefined(c: Column) -> Column:
    return F.coalesce(F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c), F.lit(0.0))


def unit_economics(values: DataFrame, cac: DataFrame, margin: float = GROSS_MARGIN) -> DataFrame:
    """A payback of 0 also stands for never; pays_back tells them apart."""
    arpu = values.where("channel is not null").groupBy("channel").agg(F.avg("arpu").alias("avg_arpu"))
    u = cac.join(beside(arpu), "channel", "left").withColumn("avg_arpu", F.round(F.coalesce("avg_arpu", F.lit(0.0)), 9))
    monthly = F.col("avg_arpu") * F.lit(margin)
    return u.withColumns({
        "ltv_cac_ratio": zero_if_undefined(F.col("avg_arpu") * 8 * F.lit(margin) / F.greatest("cac", F.lit(1.0))),
        "contribution_margin": zero_if_undefined(monthly - F.col("cac") / 6),
        "payback_period_months": zero_if_undefined(F.try_divide(F.col("cac"), monthly)),
        "pays_back": monthly > 0,
    })
