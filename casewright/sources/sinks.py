"""Outputs of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.schemas import CASE_FIELDS, LABELS


def export_rows(cases: DataFrame, *keep: str) -> DataFrame:
    """The seven columns of the export under their labels, empty where null."""
    return cases.select(*keep, *(F.coalesce(F.col(c), F.lit("")).alias(LABELS[c]) for c in CASE_FIELDS))


def write_outputs(cases: DataFrame, path: str, order: tuple[str, ...] = ("doc_ord", "section_no", "case_no"), kind: str = "csv") -> None:
    """One folder for each out_name, in order; a rerun replaces only the documents that it has rows of.

    Spark commits a folder's files together, so readers never see half a document; documents without rows give nothing.
    """
    rows = cases.repartition("out_name").sortWithinPartitions("out_name", *[c for c in order if c in cases.columns])
    rows = export_rows(rows, "out_name")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").option("escape", '"').partitionBy("out_name").format(kind).save(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Appends JSON lines, as failure and audit logs are kept."""
    rows.write.mode("append").json(path)


def audit_rows(calls: DataFrame) -> DataFrame:
    """Adds time_utc, and removes tokens from the map ``headers``."""
    return calls.withColumns({"headers": X.redacted(F.col("headers")), "time_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
