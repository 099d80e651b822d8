"""Contracts: required columns, keys, references, ranges and rules for score records."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: The columns that published tables must have.
REQUIRED = {
    "dim_customers": ["customer_id", "signup_date", "channel", "segment"],
    "dim_date": ["date_key", "date", "year", "month", "week_of_year", "day_of_week"],
    "dim_channel": ["channel_key", "channel"],
    "fact_orders": ["order_id", "customer_id", "channel_key", "date_key", "order_date", "order_amount", "order_count"],
}
KEYS = {"dim_customers": "customer_id", "dim_date": "date_key", "dim_channel": "channel_key", "fact_orders": "order_id"}
REFERENCES = [("fact_orders", "customer_id", "dim_customers"), ("fact_orders", "date_key", "dim_date"), ("fact_orders", "channel_key", "dim_channel")]
WHOLE, NUMBERS, TEXTS = ("recency_days", "frequency", "tenure_days"), ("monetary", "avg_order_value", "arpu"), ("channel", "segment")


def contract_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each required column, from schemas alone, with the table's row count."""
    parts = []
    for name, df in tables.items():
        has = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present")) for c in REQUIRED[name]])
        n = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(n.select(F.lit(name).alias("table_name"), F.explode(has).alias("c"), "n_rows").select("table_name", "c.column_name", "c.present", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def key_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Nulls and repeated values of each table's key."""
    parts = []
    for name, df in tables.items():
        n = df.groupBy(F.col(KEYS[name]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(n.agg(
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
            F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated_keys"),
        ).select(F.lit(name).alias("table_name"), "null_keys", "repeated_keys"))
    return reduce(DataFrame.unionByName, parts)


def referential_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose reference is null, and rows whose reference leads nowhere."""
    parts = []
    for child, column, parent in REFERENCES:
        c, p = tables[child].select(F.col(column).alias("k")), tables[parent].select(F.col(column).alias("k"))
        orphans = c.where("k is not null").join(p, "k", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
        nulls = c.agg(F.count_if(F.col("k").isNull()).alias("null_references"))
        parts.append(orphans.crossJoin(nulls).select(F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), "orphans", "null_references"))
    return reduce(DataFrame.unionByName, parts)


def watched(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The table, and what its next action sees on the way: rows and null keys, without a scan of their own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(KEYS[name]).isNull()).alias("null_keys")), seen


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    n = df.where(F.col(KEYS[name]).isNotNull()).groupBy(F.col(KEYS[name]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))


def sound(tables: dict[str, DataFrame], seen: dict[str, Observation], refuse: tuple[str, ...] = ("repeated_keys",)) -> DataFrame:
    """table_name, n_rows, null_keys, repeated_keys, orphans of written tables; raises where one of those to refuse isn't 0.

    seen: what `watched` gave for each table that has been written since. Orders of customers whose own row is
    incomplete are kept by silver, so orphans are reported, and refused only where that is asked for.
    """
    spark = next(iter(tables.values())).sparkSession
    orphans: dict[str, int] = {}
    for r in referential_checks(tables).collect():
        orphans[r["table_name"]] = orphans.get(r["table_name"], 0) + r["orphans"]
    rows = [(n, seen[n].get["n_rows"], seen[n].get["null_keys"], repeated_keys(tables[n], n).first()[0], orphans.get(n, 0)) for n in KEYS]
    columns = ["table_name", "n_rows", "null_keys", "repeated_keys", "orphans"]
    if bad := [f"{r[0]}: {r[i]} {c}" for r in rows for i, c in enumerate(columns) if c in refuse and r[i]]:
        raise ValueError(f"gold tables are not sound: {', '.join(bad)}")
    return spark.createDataFrame(rows, "table_name string, n_rows long, null_keys long, repeated_keys long, orphans long")


def out_of_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.agg(F.count_if(~F.col(column).between(lo, hi)).alias("out_of_range"), F.count(F.lit(1)).alias("n_rows"))


def validated_records(records: DataFrame) -> DataFrame:
    """Score records with _errors: the names of the fields that break a rule, in a fixed order."""
    bad = [F.when(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) != F.floor(c)), F.lit(c)) for c in WHOLE]
    bad += [F.when(F.col(c).isNull() | (F.col(c) < 0) | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in NUMBERS]
    bad += [F.when(F.col(c).isNull() | (F.length(c) < 1), F.lit(c)) for c in TEXTS]
    return records.withColumn("_errors", F.array_compact(F.array(*bad)))


def accepted(records: DataFrame) -> DataFrame:
    return validated_records(records).where(F.size("_errors") == 0).drop("_errors")


def rejected(records: DataFrame) -> DataFrame:
    return validated_records(records).where(F.size("_errors") > 0)
