"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs in one process, as in tests, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ledgerlight.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerlight-")
        spark.conf.set("ledgerlight.shared.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """The table, written to the shared folder and read again.

    It cuts the lineage, and a lost executor costs no more than the reading of a file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a stored table that nothing reads any more, such as that of a round before the last."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(small: DataFrame, name: str = "beside", most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most `most` rows; else joins with it shuffle.

    It is stored, so that what it is made of isn't computed for the count and again for the join.
    """
    table = stored(small, name)
    return F.broadcast(table) if table.count() <= most else table
