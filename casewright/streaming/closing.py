"""Streams whose state ends: jobs that close at their result or error, and replies put in order as their lines arrive.

Both emit one row for each key, when it closes, and remember of a closed key only that it is closed, until nothing of it has
come for a while; then its state is gone.  What never closes is closed by the same timer.  Time is that of arrival, as later
events show it: a stream that is run for what is available ends, and its timers go on when more has come.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from casewright.operators.replies import reply_parts
from casewright.streaming.events import FAILED, INCOMPLETE

#: Milliseconds without any event of a key after which its state ends.
IDLE_MS = 3_600_000
#: These streams keep their state on disk and write its changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Start the queries of this module inside: they need a state store of this kind."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 second")


class _Closing(StatefulProcessor):
    """Keys with one timer each, which is set anew by whatever comes."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def wait(self, arrived: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(arrived * 1000) + self.idle)

    def close(self) -> None:
        pass


class _Job(_Closing):
    """(closed, seq and payload of the last result so far)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "closed boolean, seq long, result string")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        closed, seq, result = self.state.get() or (False, None, None)
        error, ended, arrived = None, False, 0.0
        for r in rows:
            arrived = max(arrived, r.arrived.timestamp())
            if r.type == "error" and (error is None or r.seq < error[0]):
                error = (r.seq, r.message or FAILED)
            elif r.type == "result" and (seq is None or r.seq >= seq):
                seq, result = r.seq, r.payload
            ended = ended or r.type == "end"
        if not closed:
            if error is not None:
                closed, result = True, None
                yield Row(job_id=key[0], status="failed", message=error[1], result=None)
            elif ended:
                closed = True
                yield self.told(key, seq, result)
        self.state.update((closed, None if closed else seq, None if closed else result))
        self.wait(arrived)

    def told(self, key, seq, result) -> Row:
        return Row(job_id=key[0], status="incomplete" if seq is None else "done", message=INCOMPLETE if seq is None else None, result=result)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed, seq, result = self.state.get() or (True, None, None)
        self.state.clear()
        if not closed:
            yield self.told(key, seq, result)


def fold_stream(events: DataFrame, payload: Column | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """job_id, status, message and result (JSON) of each job, once, from a stream of (job_id, seq, type, message) and a payload.

    As streaming.events.fold_jobs, in append mode: the first error closes a job; an event of type "end" closes it with its
    last result, or as incomplete without any; so does the timer after ``idle_ms`` without events.  What comes for a
    closed job changes nothing.
    """
    value = F.to_json(payload if payload is not None else F.struct("rows", "errors", "template", "file_results"))
    rows = events.where("type IN ('error', 'result', 'end', 'progress')").select("job_id", F.col("seq").cast("long").alias("seq"), "type", F.when(F.col("type") == "error", F.col("message")).alias("message"), F.when(F.col("type") == "result", value).alias("payload"))
    kind = events.schema["job_id"].dataType.simpleString()
    return _timed(rows).groupBy("job_id").transformWithState(_Job(idle_ms), f"job_id {kind}, status string, message string, result string", "append", "eventTime")


class _Reply(_Closing):
    """(closed, the next line's number, the text so far), and the lines that came before their turn."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reply", "closed boolean, next long, text string")
        self.early = handle.getMapState("early", "seq long", "done boolean, part string")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        closed, turn, text = self.state.get() or (False, 0, "")
        text = text or ""
        was_closed, here, arrived, parts = closed, {}, 0.0, [text]
        for r in rows:
            arrived = max(arrived, r.arrived.timestamp())
            if not closed and r.seq >= turn:
                here[r.seq] = (r.done, r.part)
        while not closed:
            known = here.pop(turn, None)
            if known is None and self.early.containsKey((turn,)):
                known = self.early.getValue((turn,))
                self.early.removeKey((turn,))
            if known is None:
                break
            closed, turn = bool(known[0]), turn + 1
            if not closed:
                parts.append(known[1] or "")
        if was_closed:
            pass
        elif closed:
            self.early.clear()
            yield Row(request_id=key[0], content="".join(parts))
        else:
            text = "".join(parts)
            for seq, line in here.items():
                self.early.updateValue((seq,), line)
        self.state.update((closed, turn, None if closed else text))
        self.wait(arrived)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed, _, text = self.state.get() or (True, 0, "")
        if not closed:
            parts = [text or ""]
            for _, (done, part) in sorted((tuple(k), v) for k, v in self.early.iterator()):
                if done:
                    break
                parts.append(part or "")
            yield Row(request_id=key[0], content="".join(parts))
        self.early.clear()
        self.state.clear()


def assembled_stream(lines: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """request_id and content of streamed replies, once each, from a stream of (request_id, seq from 0, line) in any order.

    As operators.replies.assembled, in append mode.  Lines that come before their turn wait in a map by number; those whose
    turn it is are added to the text; [DONE] closes the reply, and what comes after it is dropped.  A reply without [DONE]
    is closed by the timer, with the lines that are there in order.
    """
    kind = lines.schema["request_id"].dataType.simpleString()
    return _timed(reply_parts(lines)).groupBy("request_id").transformWithState(_Reply(idle_ms), f"request_id {kind}, content string", "append", "eventTime")
