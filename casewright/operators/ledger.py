"""A ledger of calls: each answer is written as it comes, so that no answered payload is ever asked again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.sources.commits import delete, qualified
from casewright.sources.listed import file_system

ANSWERS = "digest string, content string, error string, attempt int, run string, at double"
ARROW = pa.schema([("digest", pa.string()), ("content", pa.string()), ("error", pa.string()), ("attempt", pa.int32()), ("run", pa.string()), ("at", pa.float64())])
#: Fixed value: a call is tried so often while its failure is worth another try.
ATTEMPTS = 6
#: Payloads that a caller is given at once, and what a task may hold of its answers before it writes them: the files of a quick
#: caller are few, a slow one loses no more than these seconds with an executor.
PIECE, FLUSH_SECONDS, FLUSH_CHARS = 32, 20.0, 16 << 20

Answer = tuple[str | None, str | None]
Caller = Callable[[list[str]], Iterable[str | Exception]]


def each(ask: Callable[[str], str]) -> Caller:
    """A caller that asks one payload after another and gives each reply, or what was raised in its place, at once."""

    def caller(payloads: list[str]) -> Iterator[str | Exception]:
        for p in payloads:
            try:
                yield ask(p)
            except Exception as e:
                yield e

    return caller


def _answer(x: Any) -> Answer:
    return (None, str(x) or type(x).__name__) if isinstance(x, Exception) else (None if x is None else str(x), None)


def answers(caller: Caller, payloads: list[str]) -> Iterator[Answer]:
    """content and error of each payload, in order.

    Replies that came before a caller raised stand; the payload it raised at has the error, and those after it are asked
    next.  A caller of several payloads that raised before any reply has answered none, so they are asked one by one.
    """
    at = 0
    while at < len(payloads):
        asked, came = payloads[at:], 0
        try:
            for x in caller(asked):
                if came == len(asked):
                    break
                came += 1
                yield _answer(x)
            failed: Exception = ValueError("as many replies as requests are expected")
        except Exception as e:
            failed = e
        at += came
        if came == 0 and len(asked) > 1:
            for p in asked:
                yield from answers(caller, [p])
            return
        if came < len(asked):
            yield _answer(failed)
            at += 1


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of a ledger, of lost runs too; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(folder)


def latest(entries: DataFrame) -> DataFrame:
    """digest, content, error and attempt: an entry for each payload, the first good one or else the last failure."""
    bad = F.col("error").isNotNull()
    order = F.struct(bad.alias("bad"), F.when(bad, -F.col("at")).otherwise(F.col("at")).alias("at"), "content", "error", "attempt")
    return entries.groupBy("digest").agg(F.min(order).alias("e")).select("digest", "e.content", "e.error", "e.attempt")


def _round(todo: DataFrame, caller: Caller, folder: str, run: str, attempt: int, piece: int, seconds: float = FLUSH_SECONDS) -> None:
    """Asks the payloads of ``todo`` (digest, payload; dealt by digest) and leaves the answers below ``folder``."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = f"{folder}/part={TaskContext.get().partitionId()}"
        system, inner = file_system(mine)
        system.create_dir(inner, recursive=True)
        # what an earlier attempt of this task, lost with its executor, was answered
        known = {d for f in system.get_file_info(pafs.FileSelector(inner)) if f.base_name.startswith("answers-") for d in pq.read_table(system.open_input_file(f.path), columns=["digest"])["digest"].to_pylist()}

        held: list[dict[str, Any]] = []
        since, chars = time.monotonic(), 0

        def write() -> None:
            nonlocal since, chars
            if held:
                name = uuid.uuid4().hex
                with system.open_output_stream(f"{inner}/_{name}") as f:
                    pq.write_table(pa.Table.from_pylist(held, ARROW), f)
                system.move(f"{inner}/_{name}", f"{inner}/answers-{name}.parquet")  # appears as a whole
                held.clear()
            since, chars = time.monotonic(), 0

        try:
            for b in batches:
                left = b[~b.digest.isin(known)]
                for start in range(0, len(left), piece):
                    part = left.iloc[start : start + piece]
                    for digest, (content, error) in zip(part.digest, answers(caller, part.payload.tolist())):
                        held.append({"digest": digest, "content": content, "error": error, "attempt": attempt, "run": run, "at": time.time()})
                        chars += len(content or error or "")
                        if chars > FLUSH_CHARS or time.monotonic() - since > seconds:
                            write()
                yield pd.DataFrame({"n": [len(left)]})
        finally:  # also when the task is stopped in between
            write()

    todo.select("digest", "payload").mapInPandas(ask, "n long").write.format("noop").mode("overwrite").save()


def call_once(requested: DataFrame, caller: Caller, folder: str, keys: list[str] | None = None, tasks: int | None = None, attempts: int = ATTEMPTS, piece: int = PIECE, seconds: float = FLUSH_SECONDS) -> DataFrame:
    """``keys`` (doc_id, section_no), content, error and attempt of each row of ``requested`` (keys, payload).

    Equal payloads are one call.  Calls are known by a digest of the payload: what ``folder`` has a good answer for, of a
    run that was lost too, is not asked.  Failures that are worth another try form the next round, at most ``attempts``
    rounds in all; earlier runs' failures do not count.  A task writes its answers every ``seconds`` (and 16 M characters), and
    one that runs again after a lost executor reads them, so at most the answers of its last seconds are asked twice.
    ``caller`` is given ``piece`` payloads at a time, maps them to replies and should give them one by one (:func:`each`).  Waiting between tries is the caller's business.
    A null payload is an empty one.  A payload runs in one task at a time only without speculative execution.
    """
    spark, keys, run = requested.sparkSession, keys or ["doc_id", "section_no"], uuid.uuid4().hex
    if spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("speculative execution would ask payloads twice: set spark.speculation to false")
    folder = qualified(spark, folder)
    rows = requested.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("digest", F.sha2("payload", 256))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, for calls are slow however short their payloads
    known, how = read(spark, folder).where("error IS NULL").select("digest").distinct(), "left_anti"
    for attempt in range(1, attempts + 1):
        now = f"{folder}/run={run}/attempt={attempt}"
        # what is asked is chosen before payloads are made distinct, so that later rounds shuffle just those that failed
        todo = rows.select("digest", "payload").join(known, "digest", how).dropDuplicates(["digest"])
        _round(todo.repartition(tasks, "digest"), caller, f"{now}/pieces", run, attempt, piece, seconds)
        # many small files become a few; a run lost in between leaves entries twice, which :func:`latest` makes one
        read(spark, f"{now}/pieces").repartition("digest").write.mode("overwrite").parquet(f"{now}/table")
        delete(spark, f"{now}/pieces")
        again = read(spark, f"{now}/table").where(F.col("error").isNotNull() & X.is_retryable(F.col("error"))).select("digest").distinct()
        if attempt == attempts or again.isEmpty():
            break
        known, how = again, "left_semi"
    entries = read(spark, folder).where((F.col("run") == run) | F.col("error").isNull())
    return rows.select(*keys, "digest").join(latest(entries), "digest", "left").select(*keys, "content", "error", "attempt")
