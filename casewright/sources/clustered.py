"""Outputs of many documents in few files: rows in ranges of documents, and an index of where each document's rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources import commits

#: Rows of a file, about: a document that has more lies in several files, one after another.
ROWS_A_FILE = 200_000
ORDER = ("doc_id", "section_no", "case_no")


def write(rows: DataFrame, folder: str, index: str, order: tuple[str, ...] = ORDER, rows_a_file: int = ROWS_A_FILE) -> None:
    """Writes ``rows`` (out_name, ...) sorted by out_name and those of ``order`` that they have, and their index.

    Files are ranges of that order, so their number follows the rows and not the documents, and no document is one task
    however many rows it has.  ``index``: out_name, file, first_row (place in the file, from 0) and n_rows, sorted by out_name;
    made from what was written, without texts.  Give rows that are written already: they are counted, sampled and read.
    """
    by = ["out_name", *(c for c in order if c in rows.columns)]
    files = max(1, -(-rows.count() // rows_a_file))
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(folder)
    placed = rows.sparkSession.read.schema(rows.schema).parquet(folder).select("out_name", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = placed.groupBy("out_name", "file").agg(F.min("row").alias("first_row"), F.count("*").alias("n_rows"))
    found.repartitionByRange(files, "out_name", "file").sortWithinPartitions("out_name", "file").write.mode("overwrite").parquet(index)


def at(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows (file, row, ...) that ``index`` says are a document's, with its out_name as ``owner``; joined by file and block of rows.

    An entry is given to each block of 1,024 rows that it reaches into, so a file is no one task.
    """
    block = lambda c: F.floor(c / 1024)
    reach = index.withColumn("block", F.explode(F.sequence(block(F.col("first_row")), block(F.col("first_row") + F.col("n_rows") - 1))))
    reach = reach.select("file", "block", F.col("out_name").alias("owner"), "first_row", "n_rows")
    near = rows.withColumn("block", block(F.col("row"))).join(reach, ["file", "block"])
    return near.where("row >= first_row AND row < first_row + n_rows").drop("block", "first_row", "n_rows")


def document(spark: SparkSession, output: str, out_name: str) -> DataFrame | None:
    """A document's cases in order, as the latest committed run of ``output`` that wrote it has them; None if none has.

    Only the index and the files that it names are opened, and of these what can hold the document.
    """
    index = commits.latest(spark, output, "index")
    entries = index.where(F.col("out_name") == out_name).select("run", "file").collect() if index is not None else []  # a row for each of its files
    if not entries:
        return None
    rows = spark.read.parquet(*(f"{output}/cases/run={e.run}/{e.file}" for e in entries)).where(F.col("out_name") == out_name)
    return rows.orderBy(*(c for c in ORDER if c in rows.columns))
