"""Ordered scans over groups of any size: rows are dealt in ranges of the order, and ranges pass on what they end with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources.work import kept


def dealt_in_ranges(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """As :func:`in_ranges`, not held yet: for one reading, whose result has to be."""
    by = [*keys, *order]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})


def in_ranges(rows: DataFrame, keys: list[str], order: list[Column | str], drop: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Adds _range and _place: rows dealt in ranges of (keys, order), and their place; a key may take many ranges.

    Ranges are drawn from a sample and places are counted as the rows come, so ``keep`` has to hold them: it writes and
    rereads.  ``drop``: columns that are needed for the order alone.
    """
    return keep(dealt_in_ranges(rows, keys, order).drop(*drop))


def at_borders(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that a range begins or ends with: at most two for each range, so the table may be sent to all tasks."""
    key = F.struct(*keys)
    ends = placed.groupBy("_range").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    return ends.select(F.explode(F.array("a", "z")).alias("_key")).distinct()


def running_sums(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], drop: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Adds, for each name of ``sums``, the sum over the rows of the same keys up to this one in ``order``.

    No task needs the rows of a key together.  ``order`` should tell all rows of a key apart; see :func:`in_ranges`.
    """
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    placed = in_ranges(rows.withColumns(values), keys, order, drop, keep)
    own = Window.partitionBy("_range", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    border, key = F.broadcast(at_borders(placed, keys)), F.struct(*keys)
    parts = placed.withColumn("_k", key).join(border, F.col("_k").eqNullSafe(F.col("_key")), "left_semi").groupBy("_k", "_range").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most two rows a range in all
    carried = parts.select(F.col("_k"), F.col("_range").alias("_r"), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_c{v}") for v in values))
    within = placed.withColumns({f"_s{v}": F.sum(v).over(own) for v in values})
    joined = within.join(F.broadcast(carried), (F.col("_range") == F.col("_r")) & key.eqNullSafe(F.col("_k")), "left")
    total = {name: F.col(f"_s{v}") + F.coalesce(F.col(f"_c{v}"), F.lit(0)) for name, v in zip(sums, values)}
    return joined.select(*(c for c in placed.columns if c not in values and c not in ("_range", "_place") and c not in sums), *(c.alias(n) for n, c in total.items()))


#: Keys with more than this part of all rows are sent to all tasks; there are no more than so many.
HOT_KEYS = 10_000


def marked(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int, flag: str) -> DataFrame:
    """Adds ``flag``: whether ``keys``, unique on ``on``, has the row's key.  ``size``: how many of ``total`` rows have it.

    At most HOT_KEYS keys can have more than a HOT_KEYS-th of the rows: these are sent to all tasks, and only rows of other
    keys are dealt by them.  Give ``rows`` kept, for they are read twice.
    """
    hot = F.col(size) > total // HOT_KEYS + 1000
    few = F.broadcast(keys.where(hot).select(*on))
    here = rows.join(few, on, "left_semi").withColumn(flag, F.lit(True))
    rest = rows.join(few, on, "left_anti").join(keys.where(~hot).select(*on, F.lit(True).alias(flag)), on, "left")
    return here.unionByName(rest.withColumn(flag, F.coalesce(flag, F.lit(False))))
