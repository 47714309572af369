"""Mixing sources to target weights (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import small, written

#: No document is taken more often than this.
MOST_EPOCHS = 3
#: The corpus has about 2 to this power blocks at any size, so that blocks grow with it.
BLOCK_BITS = 20
#: Blocks that each source is cut into at least, if it has so many words.
LEAST_BLOCKS = 256
#: Each source's shuffled order is cut into so many stretches, so that no task has to order a whole source.
STRETCHES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target of each source, from rows (source, source_size).

    Targets share the whole by weight; where one exceeds ``MOST_EPOCHS`` times its source's size it stops there and the
    rest is shared anew.  That is a level L with the sum of min(L * weight, cap) equal to the whole: ordered by
    cap / weight, the sources that stop are a prefix, found with running sums.  One row a source goes through this.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ratio = every.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8"))
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * MOST_EPOCHS).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("stops", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    target = F.when(F.col("stops").isNull() | (F.col("ratio") <= F.col("stops")), F.col("cap")).otherwise(F.col("weight") * F.col("stops"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def slots(sources: DataFrame, n_slots: int) -> DataFrame:
    """(source_no, slot, nth): which slots of the schedule each source gets; nth counts a source's own from 0.

    Slot k has the van der Corput point of k, which is its bits reversed and so a multiple of a power of two.  A source
    owns the points in its stretch of the cumulative weights; they are listed from the sources, so that no join over a
    range is needed.  There are at least as many points as slots: of its own, a source uses the first that it needs.
    """
    bits = max(1, (n_slots - 1).bit_length())
    edge = lambda c: F.ceil(c * F.lit(float(1 << bits)) / F.lit(float(n_slots)))
    own = sources.where("n_slots > 0").withColumn("first", edge(F.col("slots_before"))).withColumn("last", edge(F.col("slots_before") + F.col("n_slots")))
    points = own.select("source_no", "n_slots", F.explode(F.sequence("first", F.col("last") - 1)).alias("point"))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    nth = F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1
    return points.select("source_no", "n_slots", slot.alias("slot")).withColumn("nth", nth).where("nth < n_slots").select("source_no", "slot", "nth")


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` to the target weights.  Returns (documents, mix).

    documents: doc_id, source, size, source_size, target, source_no, start; one row for each row of ``docs``.
    mix: slot, source_no, start, from_word, words: the stretch of the document at (source_no, start) that the slot takes.
    The order of slots is the order of the mix.

    Each source's documents are shuffled by a hash of their id and text, laid end to end and cut into blocks of equal words.  The
    n-th slot of a source takes its block n modulo the number of blocks, so each pass over a source ends before the next
    begins.  Null or wordless texts have size 0 and are never taken; a null source is a source of its own, the last by
    name; repeated rows and null ids are rows like others; an empty table gives empty results.
    """
    seed = F.xxhash64(F.lit("mixing"), id_col, text_col)
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), seed.alias("mixed")).withColumn("stretch", F.shiftrightunsigned("mixed", 64 - (STRETCHES - 1).bit_length())), "sized")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    block = max(1.0, total / (1 << BLOCK_BITS))
    blocks = F.least(F.col("source_size"), F.greatest(F.lit(LEAST_BLOCKS), F.round(F.col("source_size") / block).cast("long")))
    every = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    sources = sources.withColumn("n_blocks", blocks).withColumn("n_slots", F.coalesce(F.round(F.col("target") * F.col("n_blocks") / F.nullif("source_size", F.lit(0))), F.lit(0.0)).cast("long"))
    sources = sources.withColumn("source_no", F.row_number().over(every)).withColumn("slots_before", F.sum("n_slots").over(every) - F.col("n_slots"))
    sources = written(sources, "sources")
    n_slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]

    named = sources.select(F.struct("source").alias("key"), "source_size", "target", "n_blocks", "source_no")  # a null inside a struct equals a null
    parts = sized.groupBy(F.struct("source").alias("key"), "stretch").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("part_start", F.sum("part_size").over(Window.partitionBy("key").orderBy("stretch")) - F.col("part_size"))
    parts = parts.join(small(named), "key")
    inside = Window.partitionBy("key", "stretch").orderBy("mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("key", F.struct("source")).join(parts, ["key", "stretch"])
    placed = written(placed.withColumn("start", F.col("part_start") + F.sum("size").over(inside) - F.col("size")).select("doc_id", "source", "size", "source_size", "target", "n_blocks", "source_no", "start"), "placed")

    at = lambda p: F.expr(f"(({p} + 1) * n_blocks - 1) div source_size")  # noqa: E731  the block that word p of a source is in
    pieces = placed.where("size > 0").select("source_no", "start", "size", "source_size", "n_blocks", F.explode(F.sequence(at("start"), at("(start + size - 1)"))).alias("block"))
    low, high = F.greatest("start", F.expr("block * source_size div n_blocks")), F.least(F.col("start") + F.col("size"), F.expr("(block + 1) * source_size div n_blocks"))
    pieces = pieces.select("source_no", "block", "start", (low - F.col("start")).alias("from_word"), (high - low).alias("words")).where("words > 0")
    turns = slots(sources, n_slots).join(small(sources.select("source_no", "n_blocks")), "source_no").select("source_no", "slot", F.expr("nth % n_blocks").alias("block"))
    mix = pieces.join(turns, ["source_no", "block"]).select("slot", "source_no", "start", "from_word", "words")
    return placed.drop("n_blocks"), mix


def mixed_words(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each row of ``docs``."""
    placed, mix = mixture(docs, **columns)
    taken = mix.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    full = placed.where("size > 0").join(taken, ["source_no", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return full.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
