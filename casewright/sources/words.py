"""Pages of positioned words and table boxes as blocks: what stands between tables becomes text, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators.lines import joined

#: Words whose tops follow each other by no more than this are one line; a band has to be taller than LEAST_BAND to have text.
LINE_STEP, LEAST_BAND = 3.0, 1.0
PAGE = ("doc_id", "page")
_BOX = ("x0", "top", "x1", "bottom")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with a whole box; coordinates as doubles."""
    known = rows.dropna(subset=list(_BOX))
    return known.withColumns({c: F.col(c).cast("double") for c in _BOX}).where("x0 <= x1 AND top <= bottom")


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.repartition(tasks, *PAGE) if tasks else rows.repartition(*PAGE)


def bands(tables: DataFrame, sizes: DataFrame, tasks: int | None = None) -> DataFrame:
    """The bands of each page that has tables, in reading order: doc_id, page, width, place, start, end and the table below.

    Band n ends where table n begins, in order of rounded places, and starts at the lowest edge of all tables before it;
    the last one ends with the page and has no table.  ``place`` is 2n, its table's 2n + 1; what lies outside a page is cut
    to it.  A page without a size has no end.
    """
    inf = F.lit(float("inf"))
    known = _dealt(sizes, tasks).groupBy(*PAGE).agg(F.max("width").cast("double").alias("width"), F.max("height").cast("double").alias("height"))
    boxes = _dealt(_placed(tables), tasks).join(known, list(PAGE), "left").withColumns({"width": F.coalesce("width", inf), "height": F.coalesce("height", inf)})
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col("height")))
    order = Window.partitionBy(*PAGE).orderBy(F.round("top", 2), F.round("x0", 2), "table_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = boxes.select(*PAGE, "width", "height", "cells", cut("top").alias("end"), F.coalesce(F.max(cut("bottom")).over(before), F.lit(0.0)).alias("start"), cut("bottom").alias("low"), F.row_number().over(order).alias("n"))
    last = found.groupBy(*PAGE).agg(F.first("width").alias("width"), F.max("height").alias("end"), F.max("low").alias("start"), (2 * F.max("n")).cast("long").alias("place"))
    upper = found.select(*PAGE, "width", (2 * F.col("n") - 2).cast("long").alias("place"), "start", "end", "cells")
    return upper.unionByName(last.withColumn("cells", F.lit(None).cast(found.schema["cells"].dataType)))


def _by_band(words: DataFrame, gaps: DataFrame, tasks: int | None) -> DataFrame:
    """Each word of (doc_id, page, x0, top, x1, bottom, word_no, text) once in every band that it touches, with its place; ``top`` is cut to the band.

    Bands do not overlap and are in order, so a word's bands are those from the first that ends at or below its top to
    the last that starts at or above its bottom: two as-of searches over words and bands in one order, dealt by page once.
    """
    open_ = gaps.where(F.col("end") > F.col("start") + LEAST_BAND)
    nth = Window.partitionBy(*PAGE).orderBy("place")
    open_ = open_.select(*PAGE, "place", F.row_number().over(nth).alias("band"), "start", "end")
    pages = gaps.groupBy(*PAGE).agg(F.first("width").alias("width"))  # of pages without an open band too
    none = lambda kind: F.lit(None).cast(kind)
    as_words = words.select(*PAGE, F.lit(1).alias("is_word"), F.col("bottom").alias("at"), F.col("top").alias("until"), none("long").alias("place"), none("int").alias("band"), none("double").alias("width"), F.struct("x0", "x1", "word_no", "text").alias("word"))
    empty = none(as_words.schema["word"].dataType).alias("word")
    as_bands = open_.select(*PAGE, F.lit(0).alias("is_word"), F.col("start").alias("at"), F.col("end").alias("until"), "place", "band", none("double").alias("width"), empty)
    as_pages = pages.select(*PAGE, F.lit(2).alias("is_word"), none("double").alias("at"), none("double").alias("until"), none("long").alias("place"), none("int").alias("band"), "width", empty)
    page = Window.partitionBy(*PAGE)
    rows = as_words.unionByName(as_bands).unionByName(as_pages)
    rows = _dealt(rows, tasks)
    rows = rows.withColumn("width", F.max("width").over(page))
    rows = rows.withColumn("to", F.max("band").over(page.orderBy("at", "is_word").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("from", F.min("band").over(page.orderBy(F.desc("until"), "is_word").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.when(F.col("is_word") == 0, F.array("band")).when(F.col("width").isNull(), F.array(F.lit(0)))  # a page without tables is one band
    crossed = F.when(F.col("from") <= F.col("to"), F.sequence("from", "to"))
    inside = (F.col("word.x0") <= F.col("width")) & (F.col("word.x1") >= 0)
    rows = rows.where("is_word < 2").withColumn("band", F.explode(F.coalesce(own, F.when(inside, crossed))))
    band = Window.partitionBy(*PAGE, "band")
    start = F.max(F.when(F.col("is_word") == 0, F.col("at"))).over(band)
    rows = rows.withColumns({"start": start, "place": F.coalesce(F.max("place").over(band), F.lit(0).cast("long"))})
    return rows.where("is_word = 1").select(*PAGE, "place", F.greatest("until", "start").alias("top"), "word.x0", "word.word_no", "word.text")


def band_texts(placed: DataFrame) -> DataFrame:
    """doc_id, page, place and text of words with a place: lines by their tops, words of a line from left to right."""
    order = Window.partitionBy(*PAGE, "place").orderBy("top", "x0", "word_no")
    new = F.when(F.col("top") > F.lag("top").over(order) + LINE_STEP, 1).otherwise(0)
    lines = placed.withColumn("new", new).withColumn("nth", F.sum("new").over(order))
    lines = lines.groupBy(*PAGE, "place", "nth").agg(joined(F.col("text"), F.struct("x0", "word_no"), " ").alias("said"))
    return lines.groupBy(*PAGE, "place").agg(joined(F.col("said"), "nth").alias("text"))


def word_blocks(words: DataFrame, tables: DataFrame, sizes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks as ``pages.page_texts`` takes them, of pages given by their words and tables.

    ``words``: doc_id, page, x0, top, x1, bottom, word_no, text; ``tables``: the same box, table_no and cells; ``sizes``:
    doc_id, page, width, height.  On a page with tables the text between them is taken over the whole width, cut to the
    page; words that lie beside a table and touch no band are left out, a word that reaches into two bands stands in
    both.  A page without tables is one text.  Left out are blank words and what has no whole box.  Ties go to word_no and
    table_no.  Pages are dealt, never documents, so a document of any length is no one task.  Give ``tasks``,
    to which pages are dealt, by the number of words, and the memory of one does not grow with the table.
    """
    said = _placed(words).withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    gaps = bands(tables, sizes, tasks)
    texts = band_texts(_by_band(said, gaps, tasks))
    cells = gaps.where("cells IS NOT NULL").select(*PAGE, (F.col("place") + 1).alias("place"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), "cells")
    texts = texts.select(*PAGE, "place", F.lit("text").alias("kind"), "text", F.lit(None).cast(gaps.schema["cells"].dataType).alias("cells"))
    at = lambda c: c.cast("double")
    return texts.unionByName(cells).select(*PAGE, at(F.col("place")).alias("top"), at(F.lit(0)).alias("left"), F.col("place").alias("block_no"), "kind", "text", "cells")
