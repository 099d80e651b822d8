"""The star schema and the three analyses over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import date_key, year_month
from ledgerlight.functions.storage import beside


def dim_date(orders: DataFrame) -> DataFrame:
    """One row for each day from the first order to the last."""
    span = orders.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b")).where("a is not null")
    d = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    c = F.col("date")
    return d.select(
        date_key(c).alias("date_key"), c.alias("date"), F.year(c).alias("year"), F.month(c).alias("month"), F.date_format(c, "MMMM").alias("month_name"),
        F.quarter(c).alias("quarter"), F.weekofyear(c).alias("week_of_year"), (F.weekday(c) + 1).alias("day_of_week"),
    )


def dim_channel(customers: DataFrame) -> DataFrame:
    n = customers.where("channel is not null").groupBy("channel").agg(F.count("customer_id").alias("acquired_customers"))
    # one row for each channel: the window runs over the aggregate
    return n.select(F.dense_rank().over(W.orderBy("channel")).alias("channel_key"), "channel", "acquired_customers")


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.withColumns({"customer_key": F.col("customer_id"), "signup_month": year_month(F.col("signup_date"))})


def order_facts(orders: DataFrame) -> DataFrame:
    """The facts that need no customer."""
    return orders.select("order_id", "customer_id", "order_date", "order_value", date_key(F.col("order_date")).alias("date_key"), F.col("order_value").alias("order_amount"), F.lit(1).alias("order_count"))


def fact_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their keys; an order of an unknown customer has a null channel_key."""
    keys = customers.join(beside(dim_channel(customers)), "channel", "left").select("customer_id", "channel_key")
    return order_facts(orders).join(keys, "customer_id", "left").select("order_id", "customer_id", "order_date", "order_value", "date_key", "channel_key", "order_amount", "order_count")


def star_schema(customers: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    return {"dim_date": dim_date(orders), "dim_channel": dim_channel(customers), "dim_customers": dim_customers(customers), "fact_orders": fact_orders(orders, customers)}


def revenue_kpis(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """By month: revenue, buyers, orders and the mean ticket."""
    g = fact.join(beside(dates.select("date_key", "year", "month")), "date_key").groupBy("year", "month")
    out = g.agg(F.sum("order_amount").alias("s"), F.countDistinct("customer_id").alias("active_customers"), F.count(F.lit(1)).alias("order_count"))
    total = F.col("s").cast("double")
    return out.select("year", "month", total.alias("gross_revenue"), "active_customers", "order_count", (total / F.col("order_count")).alias("avg_ticket")).orderBy("year", "month")


def channel_efficiency(fact: DataFrame, channels: DataFrame) -> DataFrame:
    g = fact.join(beside(channels.select("channel_key", "channel")), "channel_key").groupBy("channel")
    out = g.agg(F.sum("order_amount").alias("s"), F.countDistinct("customer_id").alias("customers"))
    total = F.col("s").cast("double")
    return out.select("channel", total.alias("revenue"), "customers", F.try_divide(total, F.col("customers")).alias("arpu")).orderBy(F.desc("revenue"))


def churn_watchlist(customers: DataFrame, fact: DataFrame, as_of=None) -> DataFrame:
    """Customers without an order in the 90 days before as_of, never-buyers included."""
    last = fact.groupBy("customer_id").agg(F.max("order_date").alias("last_order_date"), F.sum("order_amount").cast("double").alias("lifetime_revenue"))
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    out = customers.select("customer_id", "segment", "channel").join(last, "customer_id", "left")
    out = out.where(F.col("last_order_date").isNull() | (F.col("last_order_date") < F.date_sub(day, 90)))
    return out.orderBy(F.col("lifetime_revenue").desc_nulls_last(), "customer_id")


#: The star schema's columns.
TABLES = {
    "dim_date": "date_key INT, date DATE, year INT, month INT, month_name STRING, quarter INT, week_of_year INT, day_of_week INT",
    "dim_customers": "customer_key BIGINT, customer_id BIGINT, signup_date DATE, signup_month STRING, channel STRING, segment STRING, gender STRING, age INT, city STRING, membership_type STRING, satisfaction_level STRING",
    "dim_channel": "channel_key INT, channel STRING, acquired_customers BIGINT",
    "fact_orders": "order_id STRING, customer_id BIGINT, channel_key INT, date_key INT, order_date DATE, order_value DECIMAL(12,2), order_amount DECIMAL(12,2), order_count INT",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Keys and references are checked by the quality operators; tables declare none."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def fill_tables(spark: SparkSession, gold: dict[str, DataFrame], database: str = "default") -> None:
    """The star schema into its tables, whose rows it replaces; columns that a table has and the data lack are null."""
    create_tables(spark, database)
    for name in TABLES:
        table, df = spark.table(f"{database}.{name}"), gold[name]
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
        df.select(*columns).write.mode("overwrite").insertInto(f"{database}.{name}")
