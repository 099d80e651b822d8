"""Raw to bronze to silver: landing with lineage, then cleaning in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import require, try_number
from ledgerlight.sources.fixtures import BASE_CAC, mapped

LINEAGE = ("_source_file", "_ingestion_ts", "_row_seq")
#: Segments of membership types.
TIERS = {"Bronze": "SMB", "Silver": "Mid-Market", "Gold": "Enterprise"}


def bronze(raw: DataFrame, source_file: Column | str, batch_ts: Column) -> DataFrame:
    """The raw columns with the file they came from and one time for the whole batch."""
    return raw.withColumns({"_source_file": F.lit(source_file) if isinstance(source_file, str) else source_file, "_ingestion_ts": batch_ts})


def customers_from_summary(summary: DataFrame) -> DataFrame:
    """Customers with segment and days since the last purchase (30 where unknown, 1 at least)."""
    df = summary.withColumnsRenamed({c: c.lower().replace(" ", "_") for c in summary.columns})
    return df.withColumns({
        "segment": mapped(F.col("membership_type"), TIERS, "SMB"),
        "recency_days": F.greatest(F.coalesce(F.col("days_since_last_purchase"), F.lit(30)).cast("int"), F.lit(1)),
    })


def marketing_from_customers(customers: DataFrame) -> DataFrame:
    """What acquiring the customers cost, by channel."""
    n = customers.where("channel is not null").groupBy("channel").agg(F.count("customer_id").alias("customers_acquired"))
    return n.select("channel", F.bround(F.col("customers_acquired") * mapped(F.col("channel"), BASE_CAC, None), 0).cast("double").alias("marketing_spend"))


def first_of_each(df: DataFrame, key: str) -> DataFrame:
    """The first landed row of each key, null being a key too. An aggregate, so a hot key is combined before the shuffle."""
    rows = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), "_row_seq").alias("r"))
    return rows.select(key, *[F.col(f"r.{c}").alias(c) for c in df.columns if c != key]).drop(*LINEAGE)


def silver_customers_all(customers: DataFrame) -> DataFrame:
    """Before rows with missing values go: orders are checked against these."""
    require(customers, {"customer_id", "signup_date", "channel", "segment"}, "bronze customers")
    c = first_of_each(customers, "customer_id")
    return c.withColumns({"customer_id": try_number(F.col("customer_id"), "long"), "signup_date": try_number(F.col("signup_date"), "date")})


def silver_customers(customers: DataFrame) -> DataFrame:
    return silver_customers_all(customers).na.drop(subset=["customer_id", "signup_date", "channel", "segment"])


def silver_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    require(orders, {"order_id", "customer_id", "order_date", "order_value"}, "bronze orders")
    o = first_of_each(orders, "order_id").withColumns({
        "customer_id": try_number(F.col("customer_id"), "long"),
        "order_date": try_number(F.col("order_date"), "date"),
        "order_value": F.coalesce(try_number(F.col("order_value"), "decimal(12,2)"), F.lit(0).cast("decimal(12,2)")),
    })
    known = silver_customers_all(customers).select("customer_id")
    return o.join(known, "customer_id", "left_semi").where("order_value > 0").na.drop(subset=["order_id", "customer_id", "order_date"]).select("order_id", "customer_id", "order_date", "order_value")


def silver_marketing(marketing: DataFrame) -> DataFrame:
    require(marketing, {"channel", "marketing_spend"}, "bronze marketing spend")
    m = first_of_each(marketing, "channel")
    spend = F.greatest(F.coalesce(try_number(F.col("marketing_spend"), "double"), F.lit(0.0)), F.lit(0.0))
    return m.select("channel", spend.alias("marketing_spend")).na.drop(subset=["channel"])


def rejected_ids(table: DataFrame, key: str) -> DataFrame:
    """Rows whose id is no number: they are kept apart, not dropped in silence."""
    return table.where(try_number(F.col(key), "long").isNull())


def rejects(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """table_name, key, row: the bronze rows of both tables whose customer id is no number, the row as JSON."""
    parts = [rejected_ids(df, "customer_id").select(F.lit(n).alias("table_name"), F.col("customer_id").alias("key"), F.to_json(F.struct(*df.columns)).alias("row")) for n, df in (("customers", customers), ("orders", orders))]
    return parts[0].unionByName(parts[1])
