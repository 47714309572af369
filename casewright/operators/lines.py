"""Documents as lines, and lines as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as X


def to_lines(docs: DataFrame, text_col: str = "doc_text") -> DataFrame:
    """doc_id, pos (from 0) and line of every line of ``docs``, dealt by document once for all windows that follow.

    A null text is an empty one: one empty line.
    """
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line")).repartition("doc_id")


def joined(line: Column, pos: Column | str = "pos", by: str = "\n") -> Column:
    """Aggregate: the lines that are not null in order of ``pos``, joined."""
    kept = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(pos) if isinstance(pos, str) else pos, line.alias("line")))))
    return F.array_join(F.transform(kept, lambda s: s["line"]), by)


def with_headings(lines: DataFrame) -> DataFrame:
    """Adds level and title, null where the line is no heading."""
    return lines.withColumns({"level": X.heading_level(F.col("line")), "title": X.heading_title(F.col("line"))})


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")
