"""Reading and writing the layers' files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.storage import stored

#: Columns of the customer summary as delivered.
SUMMARY = (
    "`Customer ID` INT, Gender STRING, Age INT, City STRING, `Membership Type` STRING, `Total Spend` DOUBLE, `Items Purchased` INT, "
    "`Average Rating` DOUBLE, `Discount Applied` BOOLEAN, `Days Since Last Purchase` INT, `Satisfaction Level` STRING, _corrupt_record STRING"
)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows that don't parse keep their text in _corrupt_record."""
    return spark.read.schema(SUMMARY).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def row_place(file: Column, block: Column, *earlier: Column) -> Column:
    """A row's place among the rows of all files: by name, by where the part of the file that a task reads begins, and inside it.

    Tasks read parts of files in any order, but the rows of a part one after another.
    """
    return F.struct(*earlier, file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"))


def with_source_file(df: DataFrame) -> DataFrame:
    """Bronze columns of a scanned file: its name, and the row's place, by which the first of equal keys wins."""
    meta = F.col("_metadata")
    return df.withColumns({"_source_file": meta["file_name"], "_row_seq": row_place(meta["file_path"], meta["file_block_start"])})


def summary_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a summary that parse, with file and place, and the rejects: _source_file, _row_seq, and the line as it came.

    Each row is in one of both. The parsed rows are stored, as Spark finds errors only in the columns that a reader asks for.
    """
    rows = stored(with_source_file(read_summary_csv(spark, path)), "summary")
    broken = F.col("_corrupt_record").isNotNull()
    return rows.where(~broken).drop("_corrupt_record"), rows.where(broken).select("_source_file", "_row_seq", F.col("_corrupt_record").alias("line"))


def land_raw(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """Each raw table under its name, as delivered."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(kind).save(f"{path}/{name}")


#: The raw tables; what was typed in by others stays text until silver.
RAW = {
    "customers": "customer_id STRING, signup_date STRING, channel STRING, segment STRING",
    "orders": "order_id STRING, customer_id STRING, order_date STRING, order_value STRING",
    "marketing": "channel STRING, marketing_spend STRING",
}


def read_raw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The landed CSV tables with file names and row places, ready for bronze."""
    return {name: with_source_file(read_csv(spark, f"{path}/{name}", columns)) for name, columns in RAW.items()}


def write_layer(df: DataFrame, path: str, month_of: str | None = None) -> None:
    """Parquet; large tables are split by the month of a date. Months are dealt to tasks by size, so a large one has several."""
    if month_of:
        df = df.withColumn("month_part", F.date_format(month_of, "yyyy-MM"))
        df.hint("rebalance", "month_part").write.mode("overwrite").partitionBy("month_part").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


#: Rows of one key, against the mean rows of a bucket, up to which a table is bucketed: a bucket is read by one task.
HOT_BUCKET = 4


def spreads(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether buckets by the key stay of like size: no key has more than HOT_BUCKET times the mean rows of a bucket."""
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    r = each.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    return r["most"] * buckets <= HOT_BUCKET * r["total"]


def write_bucketed(df: DataFrame, path: str, table: str, key: str, buckets: int, month_of: str | None = None) -> DataFrame:
    """The layer as a table over its files, each bucket sorted by the key: joins and aggregates on the key shuffle neither side.

    One task writes a bucket, so it is one file (one for each month, where the layer is split by months). An earlier table of
    the name is replaced.
    """
    if month_of:
        df = df.withColumn("month_part", F.date_format(month_of, "yyyy-MM"))
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy("month_part") if month_of else writer).saveAsTable(table)
    return df.sparkSession.table(table).drop("month_part")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document for each row."""
    df.write.mode("overwrite").json(path)


def load_published(spark: SparkSession, root: str, tables: list[str], reports: list[str] = ()) -> dict[str, DataFrame | dict]:
    """Tables and reports of a run: DataFrames, and the JSON documents. What is missing raises; nothing is rebuilt on the way."""
    out: dict[str, DataFrame | dict] = {t: spark.read.parquet(f"{root}/processed/{t}") for t in tables}
    for name in reports:
        lines = spark.read.text(f"{root}/reports/{name}").limit(2).collect()  # a report is one line
        if len(lines) != 1:
            raise ValueError(f"report {name} has {len(lines) or 'no'} lines instead of one")
        out[name] = json.loads(lines[0][0])
    return out
