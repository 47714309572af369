"""Input files: listing, admission and names of outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.schemas import FILES
from casewright.sources.work import kept

#: Bytes of a file that is taken.
MOST_BYTES = 50 << 20
SUFFIXES = (".docx", ".pdf")


def discover(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The docx and pdf files of a folder, in either case of letters, with their bytes.

    Names that start with . or _ are not seen by Spark's file sources.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(F.lower("path").rlike(r"\.(docx|pdf)$"))


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime and length of what :func:`discover` finds; no file is opened."""
    return discover(spark, folder, recursive).select("path", "modificationTime", "length")


def discover_stream(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """As :func:`discover`, for files that are new since the stream's checkpoint."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(F.lower("path").rlike(r"\.(docx|pdf)$"))


def in_order(files: DataFrame, scope: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Adds doc_ord, the place by path within ``scope``, or of all paths; rows of one path then share a place.

    Without a scope the paths alone are dealt in ranges, numbered within each, and moved by the sizes of the ranges before;
    so no task sees all.  Ranges are drawn from a sample, so ``keep`` has to hold the numbered paths: it writes and
    rereads them.  Files are joined by path: give a listing without content.
    """
    if scope:
        return files.withColumn("doc_ord", F.row_number().over(Window.partitionBy(*scope).orderBy("path")))
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row in the lower 33
    paths = keep(files.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").select("path", place.alias("_place")))
    paths = paths.select("path", F.shiftright("_place", 33).alias("_range"), (F.col("_place").bitwiseAND((1 << 33) - 1) + 1).alias("_nth"))
    sizes = paths.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = paths.join(F.broadcast(before), "_range").select("path", (F.col("_before") + F.col("_nth")).alias("doc_ord"))  # a row for each shuffle partition
    return files.join(numbered, "path")


def admitted(files: DataFrame) -> DataFrame:
    """Adds file_name, suffix, kind (ok or bad), reason and detail to (path, length): rejects stay in the table."""
    suffix = X.extension(F.col("path"))
    bad = F.when(~suffix.isin(*SUFFIXES), "unsupported").when(F.col("length") > MOST_BYTES, "save_error")
    detail = F.when(~suffix.isin(*SUFFIXES), F.concat(F.lit("Unsupported file type: "), F.when(suffix == "", "(none)").otherwise(suffix))).when(F.col("length") > MOST_BYTES, F.lit("File exceeds 50 MB"))
    return files.withColumns({"file_name": X.base_name(F.col("path")), "suffix": suffix, "kind": F.when(bad.isNull(), "ok").otherwise("bad"), "reason": F.when(bad == "save_error", "exception").otherwise(bad), "detail": detail})


def empty_texts(docs: DataFrame) -> DataFrame:
    """doc_id, file_name, reason and detail of the documents without anything but white space."""
    return docs.where(X.is_blank(F.col("doc_text"))).select("doc_id", "file_name", F.lit("empty_text").alias("reason"), F.lit("No text could be extracted").alias("detail"))


def output_name(path: Column, by_suffix: bool = False) -> Column:
    """Stem.xlsx, or stem_suffix.xlsx so that a docx and a pdf of one name differ."""
    if not by_suffix:
        return F.concat(X.stem(path), F.lit(".xlsx"))
    suffix = F.regexp_replace(X.extension(path), r"^\.", "")
    return F.concat(X.stem(path), F.lit("_"), F.when(suffix == "", "bin").otherwise(suffix), F.lit(".xlsx"))


def collisions(files: DataFrame) -> DataFrame:
    """The files whose out_name another file has too."""
    return files.withColumn("same_name", F.count("*").over(Window.partitionBy("out_name"))).where("same_name > 1")


def not_done(files: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """The files whose out_name is not among the outputs of ``done``, a manifest table; all with ``force``."""
    return files if force else files.join(done.select("out_name"), "out_name", "left_anti")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and doc_text of text that was extracted before, a document a file; an empty file has none."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc_text"))
