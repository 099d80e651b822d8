"""The training-corpus pipeline: five operators over the documents table, one after another.

Every stage works on all that the one before kept, and its decisions take
effect: rejected languages go, one document of each near-duplicate group stays,
secrets are masked, documents are repeated or dropped to reach the sources'
targets, and the rest is packed. All stages but the last return documents.

Texts go to Python workers and back BATCH_ROWS at a time, if the session has
Spark's own default of 10,000: memory outside the heap grows with the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.functions.storage import stored
from ledgerlight.llm import language_id, near_dedup, packing, secret_scan, source_mixing
from ledgerlight.llm.common import documents, held_out

#: No SQL expresses the stages; tests compare them with brute force.
ORACLE_SQL = None


#: Words that a packing worker remembers: the heap has grown in the stages before.
STORE = 100_000
#: Rows of an Arrow batch, and Spark's setting of it.
BATCH_ROWS, SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    if spark.conf.get(SETTING) == "10000":
        spark.conf.set(SETTING, BATCH_ROWS)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return language_id.keep_identified(docs, ~held_out(4))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return packing.pack(docs, store=STORE)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
