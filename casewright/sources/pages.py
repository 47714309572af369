"""Pages of positioned blocks as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators.lines import joined


def page_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, page and page_text of (doc_id, page, top, left, block_no, kind, text, cells): blocks from top to bottom.

    Places are compared when rounded to hundredths, ties go to the smaller block_no.  Tables become pipe rows and an
    empty line; empty blocks and pages are left out.
    """
    text = F.when(F.col("kind") == "table", X.pipe_rows(F.col("cells"))).otherwise(X.strip(F.col("text")))
    part = F.when(text != "", F.when(F.col("kind") == "table", F.concat(text, F.lit("\n"))).otherwise(text))
    place = F.struct(F.round("top", 2).alias("top"), F.round("left", 2).alias("left"), "block_no").alias("pos")
    parts = blocks.select("doc_id", "page", place, part.alias("part")).repartition("doc_id")  # serves pages and documents alike
    return parts.groupBy("doc_id", "page").agg(joined(F.col("part")).alias("page_text")).where("page_text <> ''")


def page_documents(blocks: DataFrame) -> DataFrame:
    """doc_id and doc_text: the pages that are not empty, parted by empty lines, without white space at the ends."""
    pages = page_texts(blocks).groupBy("doc_id").agg(joined(F.col("page_text"), "page", "\n\n").alias("doc_text"))
    return pages.select("doc_id", X.strip(F.col("doc_text")).alias("doc_text"))
