"""Cutting documents into sections and deciding what to do with each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.schemas import CASE_FIELDS
from casewright.operators.lines import in_document, joined

PREAMBLE = "(preamble)"
TITLE_CHARS = 800
EMPTY_SECTION = "Empty section (no body text under this heading). Not sent to the LLM — review manually."


def shallowest_level(lines: DataFrame) -> DataFrame:
    """doc_id and level: the least depth of a document's headings, or null."""
    return lines.groupBy("doc_id").agg(F.min("level").alias("level"))


def cut(lines: DataFrame, opens: Column, title: Column) -> DataFrame:
    """doc_id, section_no, title and body.  Lines that open a section are not of its body; section 0 is what comes before.

    Bodies are stripped; a section without body and title is none, and one without title is called the preamble.
    """
    marked = lines.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    numbered = marked.withColumn("section_no", F.sum(F.col("_opens").cast("int")).over(in_document()).cast("int"))
    got = numbered.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("_opens"), title)).alias("_title"), X.strip(joined(F.when(~F.col("_opens"), F.col("line")))).alias("body"))
    got = got.withColumn("_title", F.coalesce("_title", F.lit("")))
    return got.where("NOT (body = '' AND _title IN ('', '(preamble)'))").select("doc_id", "section_no", F.when(F.col("_title") == "", PREAMBLE).otherwise(F.col("_title")).alias("title"), "body")


def by_headings(lines: DataFrame, level: str = "auto", ignore_table_headings: bool = False) -> DataFrame:
    """Sections at headings of exactly one level: the shallowest of each document, or 1 to 6.

    ``lines`` has level and title.  A table's header row that starts with # counts as a heading unless
    ``ignore_table_headings``.
    """
    at = level.strip().lower() or "auto"
    if ignore_table_headings:
        lines = lines.withColumn("level", F.when(~F.coalesce(F.col("title").startswith("|"), F.lit(False)), F.col("level")))
    if at == "auto":
        split = F.coalesce(F.min("level").over(Window.partitionBy("doc_id")), F.lit(1))
        return cut(lines.withColumn("_split", split), F.col("level") == F.col("_split"), F.col("title"))
    if at not in list("123456"):
        raise ValueError(f"Invalid heading level {level!r}; use auto or 1 to 6.")
    return cut(lines, F.col("level") == int(at), F.col("title"))


def pattern_hints(spark: SparkSession, hints: str) -> list[str]:
    """The patterns in a text of one a line; lines that start with # are comments.  Each is tried, alone, before use."""
    patterns = [p for p in (line.strip() for line in hints.split("\n")) if p and not p.startswith("#")]
    for p in patterns:
        try:
            spark.range(1).where(F.lit("").rlike(p)).count()
        except Exception as e:
            raise ValueError(f"Invalid section regex {p!r}: {e}") from None
    return patterns


def by_patterns(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """Sections at lines in which any pattern is found, which are the titles."""
    line = X.strip(F.col("line"))
    found = reduce(Column.__or__, [line.rlike(p) for p in patterns], F.lit(False))
    return cut(lines, (line != "") & found, F.substring(line, 1, TITLE_CHARS))


def unmatched_documents(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """doc_id of the documents in which no pattern is found, so that they are one section each."""
    line = X.strip(F.col("line"))
    found = reduce(Column.__or__, [line.rlike(p) for p in patterns], F.lit(False))
    return lines.groupBy("doc_id").agg(F.max(found & (line != "")).alias("found")).where("NOT found").select("doc_id")


def whole_documents(docs: DataFrame, text_col: str = "doc_text") -> DataFrame:
    """Every document as one section without a title."""
    return docs.select("doc_id", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("title"), F.col(text_col).alias("body"))


def with_action(sections: DataFrame) -> DataFrame:
    """Adds action: extract, skip, placeholder (an empty section with a case id) or drop."""
    blank = X.is_blank(F.col("body"))
    action = F.when(~blank & X.suggests_cases(F.col("body")), "extract").when(~blank, "skip").when(X.case_id(F.col("title")).isNotNull(), "placeholder").otherwise("drop")
    return sections.withColumn("action", action)


def section_plan(sections: DataFrame) -> DataFrame:
    """doc_id, how many sections are extracted, skipped and placed, and the titles of those skipped and placed."""
    titles = lambda a: F.transform(F.sort_array(F.collect_list(F.when(F.col("action") == a, F.struct("section_no", "title")))), lambda s: s["title"])
    return sections.groupBy("doc_id").agg(
        *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("extract", "skip", "placeholder", "drop")), titles("skip").alias("skipped_titles"), titles("placeholder").alias("placeholder_titles")
    )


def placeholder_cases(sections: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Case rows for the empty sections whose titles have an id, in their place in the document."""
    fixed = {"file_name": F.col(file_name), "test_id": X.case_id(F.col("title")), "test_name": X.strip(F.col("title")), "description": F.lit(EMPTY_SECTION)}
    return sections.where("action = 'placeholder'").select("doc_id", "section_no", F.lit(0).alias("case_no"), *(fixed.get(c, F.lit("")).alias(c) for c in CASE_FIELDS))
