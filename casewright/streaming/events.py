"""Event feeds of jobs, as batches and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewright.functions.schemas import EVENTS
from casewright.sources.files import discover_stream

# Messages of jobs that failed.
FAILED, INCOMPLETE = "Extract failed", "Incomplete extraction stream (no final result)"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A feed of JSON lines; blank lines give no event."""
    return spark.read.schema(EVENTS).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)


def fold_jobs(events: DataFrame, payload: Column | None = None) -> DataFrame:
    """job_id, status, message and result of each job, from (job_id, seq, type, message) and a payload.

    The first error fails a job, whatever result it has; otherwise the last result counts; with neither the feed is
    incomplete.  Other types are passed over.  On streams the state is a row for each job.
    """
    value = payload if payload is not None else F.struct("rows", "errors", "template", "file_results")
    got = events.groupBy("job_id").agg(
        F.min(F.when(F.col("type") == "error", F.struct("seq", F.coalesce(F.nullif("message", F.lit("")), F.lit(FAILED)).alias("message"))))["message"].alias("error"),
        F.max_by(F.when(F.col("type") == "result", value), F.when(F.col("type") == "result", F.col("seq"))).alias("result"),
        F.count_if(F.col("type") == "result").alias("n_results"),
    )
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n_results") > 0, "done").otherwise("incomplete")
    return got.select("job_id", status.alias("status"), F.coalesce("error", F.when(F.col("n_results") == 0, INCOMPLETE)).alias("message"), F.when(F.col("error").isNull(), F.col("result")).alias("result"))


def job_progress(events: DataFrame) -> DataFrame:
    """job_id, sections done and failed, retries, and the rows so far, from the progress events."""
    step, own = F.col("data.step"), F.col("type") == "progress"
    return events.where(own).groupBy("job_id").agg(
        F.count_if(step == "llm_section_done").alias("sections_done"), F.count_if(step == "llm_section_error").alias("sections_failed"), F.count_if(step == "llm_retry").alias("retries"), F.max_by("data.cumulative_rows", F.when(F.col("data.cumulative_rows").isNotNull(), F.col("seq"))).alias("cumulative_rows")
    )


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand what is new since the checkpoint to ``sink``, batch by batch, and stop."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def extract_new_files(spark: SparkSession, folder: str, extract: Callable[[DataFrame], None], checkpoint: str, recursive: bool = False) -> StreamingQuery:
    """Give the docx and pdf files that are new in a folder to ``extract``; ordered windows work there as on any batch."""
    return run_available(discover_stream(spark, folder, recursive), lambda batch, _: extract(batch), checkpoint, "append")
