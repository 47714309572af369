"""Dropping front and back matter from documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators.lines import in_document, joined, to_lines, with_headings


def mark_boilerplate(lines: DataFrame) -> DataFrame:
    """Adds level, title, skipped, and opens (the heading begins a skipped stretch) to (doc_id, pos, line).

    A boilerplate heading hides all up to the next heading of its level or above.  Seen from a line: it is hidden if for
    some level the last heading at that level or above is a boilerplate heading of just that level.
    """
    w = in_document()
    rows = with_headings(lines).withColumn("bp", F.coalesce(F.col("level").isNotNull() & X.is_boilerplate(F.col("title")), F.lit(False)))
    last = lambda c: F.last(F.when(c, F.col("pos")), ignorenulls=True).over(w)
    rows = rows.withColumns({f"_h{n}": last(F.col("level") <= n) for n in range(1, 7)} | {f"_b{n}": last(F.col("bp") & (F.col("level") == n)) for n in range(1, 7)})
    hides = lambda n: F.coalesce(F.col(f"_h{n}") == F.col(f"_b{n}"), F.lit(False))
    opens = F.col("bp") & ~reduce(Column.__or__, [hides(n) & (F.col("level") > n) for n in range(1, 7)])
    rows = rows.withColumns({"skipped": reduce(Column.__or__, [hides(n) for n in range(1, 7)]), "opens": opens})
    return rows.drop("bp", *(f"_{k}{n}" for k in "hb" for n in range(1, 7)))


def prepared_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, level and title of the lines that are left of each document.

    If nothing but white space would be left, the document's lines stay; then lines of a table of contents go.
    """
    whole = Window.partitionBy("doc_id")
    rows = mark_boilerplate(to_lines(docs))
    some = F.max(F.when(~F.col("skipped"), ~X.is_blank(F.col("line")))).over(whole)
    rows = rows.withColumn("_fallback", ~F.coalesce(some, F.lit(False)))
    return rows.where((~F.col("skipped") | F.col("_fallback")) & ~X.is_toc_line(F.col("line"))).select("doc_id", "pos", "line", "level", "title")


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, prepared_text, chars_before, chars_after, removed_titles, fallback and stripped of each document."""
    rows = mark_boilerplate(to_lines(docs))
    kept, toc = ~F.col("skipped"), X.is_toc_line(F.col("line"))
    line = F.col("line")
    got = rows.groupBy("doc_id").agg(
        joined(F.when(kept & ~toc, line)).alias("kept"),
        joined(F.when(~toc, line)).alias("all"),
        F.max(F.when(kept, ~X.is_blank(line))).alias("some"),
        F.max(~X.is_blank(line)).alias("any"),
        (F.sum(F.char_length("line")) + F.count("*") - 1).alias("chars_before"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("opens"), F.struct("pos", "title")))), lambda s: s["title"]).alias("removed_titles"),
    )
    fallback = ~F.coalesce(F.col("some"), F.lit(False)) & F.col("any")
    got = got.withColumn("fallback", fallback).withColumn("prepared_text", F.when(F.col("fallback"), F.col("all")).otherwise(F.col("kept")))
    return got.select("doc_id", "prepared_text", "chars_before", F.char_length("prepared_text").cast("long").alias("chars_after"), "removed_titles", "fallback", (F.size("removed_titles") > 0).alias("stripped"))
