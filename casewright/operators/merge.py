"""Merging runs of one test id, and flagging what is scattered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.schemas import TEXT_FIELDS
from casewright.operators.scan import dealt_in_ranges, marked
from casewright.sources.work import kept

# What reviewers read.
NOTE = "⚠ Duplicate test_id (non-contiguous): "
WARNING = ("⚠ test_id '", "' has non-contiguous duplicate rows — review required.")


def _runs(marked: DataFrame, keys: list[str], scope: list[str], place: Column, text_fields: tuple[str, ...], columns: list[str]) -> DataFrame:
    """A row for each group of ``keys``: the first row's columns, the non-blank values of text fields joined, and run_rows."""
    others = [c for c in columns if c not in scope and c not in text_fields]

    def merged(field: str) -> Column:
        kept = F.sort_array(F.collect_list(F.when(~X.is_blank(F.col(field)), F.struct(place.alias("o"), F.col(field).alias("v")))))
        alone = F.min(F.struct(place.alias("o"), F.col(field).alias("v")))["v"]
        return F.when(F.sum("_rows") > 1, F.array_join(F.transform(kept, lambda s: s["v"]), "\n")).otherwise(alone).alias(field)

    first = F.min(F.struct(place.alias("o"), *others)).alias("_first")
    got = marked.groupBy(*keys).agg(first, F.sum("_rows").alias("run_rows"), *(merged(f) for f in text_fields))
    return got.select(*([c for c in keys if c not in scope]), *((F.col(f"_first.{c}").alias(c) if c in others else F.col(c)) for c in columns), "run_rows")


def _by_scope(rows: DataFrame, scope: list[str], order: list[str], tasks: int | None) -> tuple[DataFrame, Column]:
    """``rows`` dealt to ``tasks`` by scope, if a number is given, and whether a row goes on with the run of the one before."""
    w = Window.partitionBy(*scope).orderBy(*order)
    same = F.coalesce((F.lag("test_id").over(w) == F.col("test_id")) & (F.col("test_id") != ""), F.lit(False))
    return (rows.repartition(tasks, *scope) if tasks else rows), same


def run_starts(rows: DataFrame, scope: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """scope, order and test_id of the rows of :func:`merge_runs`: the first row of each run, without making the runs."""
    dealt, same = _by_scope(rows.select(*dict.fromkeys([*scope, *order, "test_id"])), scope, order, tasks)
    return dealt.withColumn("_same", same).where("NOT _same").drop("_same")


def merge_runs(rows: DataFrame, scope: list[str], order: list[str], text_fields: tuple[str, ...] = TEXT_FIELDS, tasks: int | None = None) -> DataFrame:
    """Adjacent rows of one non-empty test_id, in ``order`` within ``scope``, become the first of them.

    Their text fields are the non-blank values joined by line feeds.  Adds run_rows, the rows that went into each.  A scope
    is ordered in one task; see :func:`merge_runs_in_ranges` for large ones.  Many small scopes may share a task: give ``tasks``
    by the number of rows, and the memory of one does not grow with the table.
    """
    w = Window.partitionBy(*scope).orderBy(*order)
    dealt, same = _by_scope(rows, scope, order, tasks)
    marked = dealt.withColumn("_starts", (~same).cast("int")).withColumns({"_run": F.sum("_starts").over(w), "_rows": F.lit(1).cast("long")})
    return _runs(marked, [*scope, "_run"], scope, F.struct(*order), text_fields, rows.columns).drop("_run")


def _continued(keys: pa.Table, scope: list[str]) -> np.ndarray:
    """Whether each row but the first has the scope and the non-empty test_id of the row before."""
    above, below = keys.slice(0, len(keys) - 1), keys.slice(1)
    same = pc.and_(pc.equal(above["test_id"], below["test_id"]), pc.not_equal(below["test_id"], ""))
    for c in scope:
        same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(above[c], below[c]), False), pc.and_(pc.is_null(above[c]), pc.is_null(below[c]))))
    return pc.fill_null(same, False).to_numpy()


def _whole_runs(rows: pa.Table, starts: np.ndarray, text_fields: tuple[str, ...]) -> pa.Table:
    """A row for each run, from the rows of whole runs and where these start."""
    sizes = np.diff(np.append(starts, len(rows)))
    several, of_several = pa.array(sizes > 1), np.repeat(sizes > 1, sizes)
    said = rows["_said"].to_numpy()
    out = rows.take(pa.array(starts)).drop_columns(["_said"])
    for i, f in enumerate(text_fields):
        taken = (said >> i & 1 == 1) & of_several
        ends = np.append(0, np.add.reduceat(taken, starts, dtype=np.int64).cumsum())
        texts = rows[f].filter(pa.array(taken)).combine_chunks()
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), texts), "\n")
        out = out.set_column(out.column_names.index(f), f, pc.if_else(several, joined, out[f]))
    return out.append_column("run_rows", pa.array(sizes, pa.int64()))


def _merged_in_order(batches: Iterator[pa.RecordBatch], scope: list[str], text_fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The merged runs of ordered rows; held are the rows of a batch and of a run that is still open."""
    keys, held = [*dict.fromkeys([*scope, "test_id"])], []
    for b in batches:
        if not b.num_rows:
            continue
        last = [held[-1].select(keys).slice(held[-1].num_rows - 1)] if held else []
        new = np.flatnonzero(~_continued(pa.Table.from_batches([*last, b.select(keys)]), scope)) + (0 if held else 1)
        if len(new):
            rows = pa.Table.from_batches([*held, b])
            before = len(rows) - b.num_rows
            starts = np.append(0, new + before)
            yield from _whole_runs(rows.slice(0, starts[-1]), starts[:-1], text_fields).to_batches()
            held = [b.slice(new[-1])]
        else:
            held.append(b)
    if held:
        yield from _whole_runs(pa.Table.from_batches(held), np.array([0]), text_fields).to_batches()


def merge_runs_in_ranges(rows: DataFrame, scope: list[str], order: list[str], text_fields: tuple[str, ...] = TEXT_FIELDS, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """As :func:`merge_runs`, for scopes of any size: no task orders a scope.

    Rows are dealt in ranges of scope and order and runs are merged within each range.  What may go on beyond a border is
    the first and the last run of a range, two rows without texts for each: from these, in order, it is found which runs are
    parts of one, over any number of ranges, and only those parts are merged once more.  ``order`` has to tell rows apart.
    """
    said = sum((F.when(~X.is_blank(F.col(f)), 1 << i).otherwise(0) for i, f in enumerate(text_fields)), F.lit(0))
    placed = dealt_in_ranges(rows.withColumn("_said", said), scope, order).withColumnRenamed("_place", "_at")
    kinds = placed.drop("_said").withColumn("run_rows", F.lit(0).cast("long")).schema
    # the place of a run's first row names it; a range is merged as its rows come in order
    parts = keep(placed.mapInArrow(lambda batches: _merged_in_order(batches, scope, text_fields), kinds))
    ends = parts.groupBy("_range").agg(F.min("_at").alias("a"), F.max("_at").alias("z"))
    outer = parts.select("_range", "_at", "test_id", F.struct(*scope).alias("_scope")).join(F.broadcast(ends), "_range").where("_at = a OR _at = z")
    line = Window.orderBy("_at")  # two rows a range at most
    before = lambda c: F.lag(c).over(line)
    goes_on = (before("_range") < F.col("_range")) & (F.col("_at") == F.col("a")) & before("_scope").eqNullSafe(F.col("_scope")) & (before("test_id") == F.col("test_id")) & (F.col("test_id") != "")
    linked = outer.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_chain", F.sum("_new").over(line))
    chains = keep(linked.withColumn("_size", F.count("*").over(Window.partitionBy("_chain"))).where("_size > 1").select("_at", "_chain"))
    again = parts.join(F.broadcast(chains), "_at").withColumnRenamed("run_rows", "_rows")
    merged = _runs(again, [*scope, "_chain"], scope, F.col("_at"), text_fields, rows.columns).drop("_chain")
    return parts.join(F.broadcast(chains), "_at", "left_anti").select(*rows.columns, "run_rows").unionByName(merged)


def flag_scattered(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Puts a note before the description of rows whose non-empty test_id is on several rows of the scope.

    Rows with an empty id, which may be most of a scope, are counted apart from each other by their place in ``order``:
    no group of them is made.
    """
    empty = F.coalesce(F.col("test_id") == "", F.lit(True))
    apart = F.when(empty, F.xxhash64(*order))
    counted = rows.withColumn("_apart", apart).withColumn("_n", F.count("*").over(Window.partitionBy(*scope, "test_id", "_apart")))
    note = F.concat(F.lit(NOTE), F.col("test_id"), F.lit("\n\n"), F.col("description"))
    return counted.withColumn("description", F.when((F.col("_n") > 1) & ~empty, note).otherwise(F.col("description"))).drop("_n", "_apart")


def flag_scattered_in_ranges(rows: DataFrame, scope: list[str], total: int) -> DataFrame:
    """As :func:`flag_scattered`, for scopes of any size and ids that any part of a scope has.

    Ids are counted with partial sums, and what is found is brought to the rows without dealing those of a frequent id to one
    task; rows with an empty id are not dealt at all.  Give ``rows`` kept, and their number as ``total``.
    """
    key = [*scope, "test_id"]
    named = rows.where("test_id <> ''")
    several = named.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    noted = marked(named, several, key, "_n", total, "_several")
    note = F.concat(F.lit(NOTE), F.col("test_id"), F.lit("\n\n"), F.col("description"))
    noted = noted.withColumn("description", F.when(F.col("_several"), note).otherwise(F.col("description"))).select(*rows.columns)
    return noted.unionByName(rows.where("test_id IS NULL OR test_id = ''"))


def scattered_warnings(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """scope, test_id, n_rows, first (its earliest place) and warning of each scattered id."""
    got = rows.where("test_id <> ''").groupBy(*scope, "test_id").agg(F.count("*").alias("n_rows"), F.min(F.struct(*order)).alias("first")).where("n_rows > 1")
    return got.withColumn("warning", F.concat(F.lit(WARNING[0]), F.col("test_id"), F.lit(WARNING[1])))
