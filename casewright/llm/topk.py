"""Exact top-k search by inner product (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import short_batches, written

#: Rows of a block of candidates, on average, and rows of the first one, whose k-th scores bound those of the others.
BLOCK, FIRST = 8192, 4096
#: Places of every list that are read before the bound is first taken; each later step reads half as many as all before.
STEP = 64


def whole_vectors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if the vector is null or holds a null, infinite or NaN component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def threshold_topk(lists: np.ndarray, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int]]:
    """Fagin's threshold algorithm for one query: (id, score) of the k best rows, best first, ties to the smaller id.

    ``least``: rows with smaller scores are not wanted, for k other rows are known to score at least so much.

    ``lists[d]`` orders the rows by component d, ascending, and is read from the end that pays for the query's sign.
    After each step the unseen rows score at most the sum of the components at the places read; once the k-th result
    is better than that bound, no unseen row can enter (an equal one still could, by a smaller id).
    """
    dims = np.flatnonzero(query)
    n, seen, best = len(rows), np.zeros(len(rows), bool), np.empty((0, 2), np.int64)
    if not len(dims):
        dims = np.arange(min(1, rows.shape[1]))
    at = 0
    while at < n:
        step = slice(at, min(n, max(STEP, at + at // 2)))
        down = lists[dims[query[dims] < 0], step]
        up = lists[dims[query[dims] >= 0]][:, ::-1][:, step]
        now = np.zeros(n, bool)
        now[down], now[up] = True, True
        fresh = np.flatnonzero(now & ~seen)
        seen |= now
        fresh = fresh[ids[fresh] != own]
        if len(fresh):
            score = (rows[fresh] @ query).astype(np.int64)
            if len(fresh) > 4 * k:  # what is below the k-th of these cannot enter
                enough = score >= np.partition(score, len(score) - k)[len(score) - k]
                fresh, score = fresh[enough], score[enough]
            best = np.concatenate([best, np.column_stack([ids[fresh], score])])
            best = best[np.lexsort((best[:, 0], -best[:, 1]))][:k]
        at = step.stop
        if len(best) == k or least is not None:
            last = [lists[d, at - 1] if query[d] < 0 else lists[d, n - at] for d in dims]
            bound = (rows[last, dims] * query[dims]).sum()
            if len(best) == k and best[-1, 1] > bound or least is not None and least > bound:
                break
    return [(int(i), int(s)) for i, s in best if least is None or s >= least]


def sorted_lists(held: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: the order of rows by each component, the rows, and their ids."""
    by_size: dict[int, list[tuple[int, list[int]]]] = {}
    for i, v in held:
        by_size.setdefault(len(v), []).append((i, v))
    out = {}
    for size, own in by_size.items():
        block = np.array([v for _, v in own], np.int64)
        out[size] = np.ascontiguousarray(np.argsort(block, axis=0, kind="stable").T), block, np.array([i for i, _ in own], np.int64)
    return out


def answers(lists: np.ndarray, block: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
    if int(np.abs(block).max()) * int(np.abs(query).max()) * len(query) < 1 << 53:  # then floating point is exact, and much faster
        block, query = block.astype(np.float64), query.astype(np.float64)
    return threshold_topk(lists, block, ids, query, own, k, least)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors by integer inner product, exactly.

    ``vectors`` and ``queries``: vec_id, embedding.  A query's own row (same vec_id) is no candidate.  Ties go to the
    smaller vec_id; fewer candidates than k give fewer rows.  Null, non-finite or empty vectors, null ids and vectors of another
    length than the query take no part; equal rows count once.

    The candidates are dealt in blocks by a hash of id and vector; a task holds one block at a time, sorted by each
    component, and the queries, sent to every block, pass by in batches.  So a vector is sent once, and the few queries
    as often as there are blocks.  A first block gives each query k scores; the k-th of them is sent along, and other
    blocks are read no further than it can be reached.  The k best of every block meet by query.
    """
    short_batches(vectors)
    spark = vectors.sparkSession
    whole = lambda df: df.select("vec_id", whole_vectors(F.col("embedding"), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").distinct()
    rows, asked = written(whole(vectors), "vectors"), written(whole(queries), "queries")
    n = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK), min(tasks, n // 1024))
    own_hash = F.xxhash64("vec_id", "v")
    first = F.shiftrightunsigned(own_hash, 1) / float(1 << 63) < (min(FIRST, n / 2) / n if n else 1.0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], {}
        for b in batches:
            out = []
            for block, asks, i, v, least in zip(*(b.column(c).to_pylist() for c in range(5))):
                if block != now:
                    now, held, ready = block, [], None
                if not asks:
                    held.append((i, v))
                    continue
                if ready is None:  # all candidates of the block have passed
                    ready = sorted_lists(held)
                if len(v) in ready:
                    out += [(i, *found) for found in answers(*ready[len(v)], np.array(v, np.int64), i, k, least)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def searched(candidates: DataFrame, sent: DataFrame) -> DataFrame:
        """query_id, vec_id and score of the best of each block, from (block, vec_id, v) and (block, vec_id, v, least)."""
        held = candidates.select("block", F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
        both = held.unionByName(sent.select("block", F.lit(True).alias("asks"), "vec_id", "v", "least"))
        return both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(search, "query_id long, vec_id long, score long")

    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, tasks // 2) - 1).cast("long")))  # the first block is searched in parts, too
    parts = rows.where(first).withColumn("block", F.pmod(own_hash, F.lit(max(1, tasks // 2))))
    some = written(searched(parts, asked.select("vec_id", "v", F.lit(None).cast("long").alias("least"), spread.alias("block"))), "first")
    known = some.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select(F.col("query_id").alias("vec_id"), F.element_at("s", k).alias("least"))
    sent = asked.join(known, "vec_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rest = searched(rows.where(~first).withColumn("block", F.pmod(own_hash, F.lit(blocks))), sent)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
