"""Point-in-time features and labels of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOK_AHEAD, SOON, LATER = 120, 30, 90
LEAST_TENURE, NO_ORDER = 60, 999


def customer_features(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """History up to as_of = last order - 120 days, and what follows in 30 and 90 days, in one pass over orders."""
    as_of = orders.agg(F.date_sub(F.max("order_date"), LOOK_AHEAD).alias("as_of_date"))
    o = orders.crossJoin(F.broadcast(as_of))  # one row
    day, at = F.col("order_date"), F.col("as_of_date")
    past = day <= at
    within = lambda n: F.count(F.when((day > at) & (day <= F.date_add(at, n)), 1))
    g = o.groupBy("customer_id").agg(
        F.max(F.when(past, day)).alias("last_order_date"),
        F.count(F.when(past, 1)).alias("frequency"),
        F.sum(F.when(past, F.col("order_value"))).cast("double").alias("monetary"),
        within(SOON).alias("future_orders_30d"),
        within(LATER).alias("future_orders_90d"),
    )
    f = customers.join(g, "customer_id", "left").crossJoin(F.broadcast(as_of))
    f = f.na.fill(0, ["frequency", "future_orders_30d", "future_orders_90d"]).na.fill(0.0, ["monetary"])
    tenure = F.greatest(F.datediff("as_of_date", "signup_date"), F.lit(1))
    f = f.withColumns({
        "avg_order_value": F.coalesce(F.try_divide(F.col("monetary"), F.col("frequency")), F.lit(0.0)),
        "recency_days": F.greatest(F.coalesce(F.datediff("as_of_date", "last_order_date"), F.lit(NO_ORDER)), F.lit(0)),
        "tenure_days": F.when(F.col("signup_date").isNotNull(), tenure),
    })
    eligible = (F.col("frequency") > 0) & (F.col("tenure_days") >= LEAST_TENURE)
    return f.withColumns({
        "is_churned": F.when(eligible, (F.col("future_orders_90d") == 0).cast("int")),
        "next_purchase_30d": F.when(eligible, (F.col("future_orders_30d") > 0).cast("int")),
        "arpu": F.when(F.col("tenure_days") > 0, F.col("monetary") / (F.col("tenure_days") / F.lit(30.0))).otherwise(0.0),
    })
