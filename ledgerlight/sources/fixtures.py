"""Canonical customer, order and marketing tables over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels, segments, and the cost of acquiring a customer by channel.
CHANNELS = {"AFRICA": "Organic", "AMERICA": "Paid Search", "ASIA": "Social Ads", "EUROPE": "Referral"}
OTHER_CHANNEL = "Partnership"
SEGMENTS = {"BUILDING": "Mid-Market", "HOUSEHOLD": "Enterprise"}
OTHER_SEGMENT = "SMB"
BASE_CAC = {"Organic": 70, "Paid Search": 180, "Social Ads": 150, "Referral": 55, "Partnership": 130}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mapped(column, values: dict, default):
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, signup_date, channel, segment."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    usual = F.date_sub(F.to_date(F.lit("1995-01-01")), (30 + (key * 37) % 700).cast("int"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        key.cast("long").alias("customer_id"),
        F.when(key % 97 == 0, F.to_date(F.lit("2001-03-01"))).otherwise(usual).alias("signup_date"),
        mapped(F.col("r_name"), CHANNELS, OTHER_CHANNEL).alias("channel"),
        mapped(F.col("c_mktsegment"), SEGMENTS, OTHER_SEGMENT).alias("segment"),
    )


def order_id():
    part = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return F.concat(F.lit("O"), part("o_custkey", 7), F.lit("-"), part("o_orderkey", 9))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, customer_id, order_date, order_value."""
    return read(spark, sf_dir, "orders").select(
        order_id().alias("order_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("order_value"),
    )


def marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, marketing_spend."""
    n = customers(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return n.select("channel", (F.col("n") * mapped(F.col("channel"), BASE_CAC, 0)).cast("double").alias("marketing_spend"))


def copies(df: DataFrame, keep) -> DataFrame:
    """Each row with copy = 0, and with copy = 1 where keep holds."""
    return df.withColumn("copy", F.explode(F.when(keep, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns as landed, with double, negative, unparsable, orphaned and undated rows."""
    key, copy = F.col("o_orderkey"), F.col("copy")
    o = copies(read(spark, sf_dir, "orders"), key % 50 == 0)
    value = (F.col("o_totalprice").cast("decimal(12,2)") + copy).cast("string")
    return o.select(
        order_id().alias("order_id"),
        F.when(key % 103 == 0, 999999999).otherwise(F.col("o_custkey")).cast("string").alias("customer_id"),
        F.when(key % 107 != 0, F.col("o_orderdate").cast("date").cast("string")).alias("order_date"),
        F.when((key % 100 == 0) & (copy == 0), "-1").when(key % 101 == 0, "n/a").otherwise(value).alias("order_value"),
        (key * 2 + copy).cast("long").alias("_row_seq"),
    )


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, copy = F.col("customer_id"), F.col("copy")
    return copies(customers(spark, sf_dir), key % 59 == 0).select(
        key.cast("string").alias("customer_id"),
        "signup_date",
        F.when(key % 53 != 0, F.col("channel")).alias("channel"),
        F.when(copy == 1, "Enterprise").otherwise(F.col("segment")).alias("segment"),
        (key * 2 + copy).cast("long").alias("_row_seq"),
    )


def customers_with_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("customer_id").cast("long")
    text = F.when(key % 83 == 0, "2001-13-45").when(key % 89 == 0, "n/a").otherwise(F.col("signup_date").cast("string"))
    return dirty_customers(spark, sf_dir).withColumn("signup_date", text)


def with_bad_ids(table: DataFrame) -> DataFrame:
    """Every id that 109 divides has a letter before it; in orders, so has that of the rows whose customer it is."""
    return table.withColumn("customer_id", F.when(F.col("customer_id").cast("long") % 109 == 0, F.concat(F.lit("x"), "customer_id")).otherwise(F.col("customer_id")))


def dirty_marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A double channel, a negative and an unparsable spend."""
    m = copies(marketing(spark, sf_dir), F.col("channel") == "Organic")
    spend = F.when(F.col("copy") == 1, "1").when(F.col("channel") == "Referral", "-5").when(F.col("channel") == "Partnership", "n/a")
    return m.select("channel", spend.otherwise(F.col("marketing_spend").cast("decimal(20,2)").cast("string")).alias("marketing_spend"), F.col("copy").cast("long").alias("_row_seq"))


def customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row for each customer, with the source's headings."""
    as_of = F.to_date(F.lit("2001-08-01"))
    o = orders(spark, sf_dir).groupBy("customer_id").agg(
        F.sum("order_value").alias("spend"), F.count(F.lit(1)).alias("items"), F.datediff(as_of, F.max("order_date")).alias("days")
    )
    c = customers(spark, sf_dir).join(o, "customer_id", "left")
    tier = mapped(F.col("segment"), {"SMB": "Bronze", "Mid-Market": "Silver"}, "Gold")
    return c.select(
        F.col("customer_id").alias("Customer ID"),
        F.when(F.col("customer_id") % 61 == 0, "Platinum").otherwise(tier).alias("Membership Type"),
        F.col("spend").cast("double").alias("Total Spend"),
        F.col("items").cast("int").alias("Items Purchased"),
        F.col("days").alias("Days Since Last Purchase"),
        F.col("channel").alias("Channel"),
        F.col("signup_date").alias("Signup Date"),
    )


def broken_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as text in the columns of its file; some amounts are no numbers, some counts no whole ones."""
    key, c = F.col("`Customer ID`"), customer_summary(spark, sf_dir)
    text = lambda name: F.col(f"`{name}`").cast("string")
    none = lambda name: F.lit(None).cast("string").alias(name)
    return c.select(
        text("Customer ID").alias("Customer ID"), none("Gender"), none("Age"), none("City"), "Membership Type",
        F.when(key % 83 == 0, "n/a, unknown").otherwise(text("Total Spend")).alias("Total Spend"),
        F.when(key % 89 == 0, "1.5.2").otherwise(text("Items Purchased")).alias("Items Purchased"),
        none("Average Rating"), F.when(key % 2 == 0, "TRUE").otherwise("FALSE").alias("Discount Applied"), text("Days Since Last Purchase").alias("Days Since Last Purchase"), none("Satisfaction Level"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, endpoint, status, latency."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"),
        F.get_json_object(F.col("props").cast("string"), "$.k").alias("status"),
        F.col("value").cast("double").alias("latency"),
    )
