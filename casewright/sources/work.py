"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.  Where that is unset, a local master gets a temporary folder, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="casewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, written and read again: what reads it twice sees the same rows, also after an executor was lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task at most, on average, where tasks are dealt by the number of rows.
TASK_ROWS = 400_000


def tasks_for(rows: DataFrame, most: int | None = None) -> int:
    """In how many tasks ``rows``, which are counted, stay within ``most`` (or TASK_ROWS); no fewer than there are cores."""
    return max(rows.count() // (most or TASK_ROWS) + 1, rows.sparkSession.sparkContext.defaultParallelism)
