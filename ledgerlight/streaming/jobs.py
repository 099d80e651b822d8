"""Streaming forms: incremental landing, scoring of records, and request metrics."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.storage import shared_dir
from ledgerlight.operators.ml import batch_scores
from ledgerlight.operators.quality import rejected
from ledgerlight.sources.files import row_place


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a table, with the table's own schema."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{parent}/{{{name}}}")


def landed(stream: DataFrame, out: str) -> None:
    """New files to bronze, with file name, time and row place (batch, file, place in the file), so that silver can read them.

    The checkpoint remembers what has landed; a batch done again replaces itself.
    """
    columns = stream.columns
    rows = stream.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_source_file"), F.col("_metadata.file_block_start").alias("_block"), F.current_timestamp().alias("_ingestion_ts"))

    def land(batch: DataFrame, number: int) -> None:
        place = row_place(F.col("_path"), F.col("_block"), F.lit(number).cast("long").alias("number"))
        batch.select(*columns, "_source_file", "_ingestion_ts", place.alias("_row_seq")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()


def scored_stream(stream: DataFrame, churn: PipelineModel, following: PipelineModel, versions: dict[str, str], out: str) -> None:
    """Valid records to out/predictions, the others to out/rejects; a batch done again replaces itself."""

    def both(batch: DataFrame, number: int) -> None:
        checked = batch.persist()  # read once for the two sinks; a lost block is read again
        try:
            batch_scores(checked, churn, following, versions).write.mode("overwrite").parquet(f"{out}/predictions/batch={number}")
            rejected(checked).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        finally:
            checked.unpersist()

    stream.writeStream.foreachBatch(both).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def request_metrics(requests: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests, mean and last latency by endpoint, status and window; the same over a stream and over a table."""
    rows = requests.withWatermark("ts", lateness) if requests.isStreaming else requests
    g = rows.groupBy(F.window("ts", width), "endpoint", "status")
    return g.agg(F.count(F.lit(1)).alias("requests"), F.avg("latency").alias("mean_latency"), F.max_by("latency", "ts").alias("last_latency")).select(
        "endpoint", "status", F.col("window.start").alias("window_start"), "requests", "mean_latency", "last_latency"
    )


def version_usage(scored: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", at: str = "scored_at") -> DataFrame:
    """Predictions by model, version and window of scored records (batch_scores), each of which counts once for each of its models."""
    rows = scored.withWatermark(at, lateness) if scored.isStreaming else scored
    each = rows.where("model_versions is not null").select(F.col(at).alias("_at"), F.explode("model_versions").alias("model", "model_version"))
    g = each.groupBy(F.window("_at", width), "model", "model_version").agg(F.count(F.lit(1)).alias("predictions"))
    return g.select("model", "model_version", F.col("window.start").alias("window_start"), "predictions")


def changes_table(aggregate: DataFrame, out: str) -> None:
    """Each batch adds the windows that it changed; windows behind the watermark leave the state. See latest_windows."""

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    aggregate.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()


def metrics_table(stream: DataFrame, out: str, **options) -> None:
    changes_table(request_metrics(stream, **options), out)


def usage_table(stream: DataFrame, out: str, **options) -> None:
    changes_table(version_usage(stream, **options), out)


def latest_windows(spark: SparkSession, out: str, key: tuple[str, ...] = ("endpoint", "status", "window_start")) -> DataFrame:
    """Each window as its last batch left it."""
    df = spark.read.parquet(out)
    values = [c for c in df.columns if c not in (*key, "batch")]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*key, *[F.col(f"v.{c}").alias(c) for c in values])
