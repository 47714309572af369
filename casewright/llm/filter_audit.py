"""Filter interaction audit by an incremental, retracting stream (operator 11)."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from casewright.llm.common import BROADCAST_ROWS, shared_dir, short_batches, sub_batches, written

#: The files of a table are dealt over this many micro-batches at most.
MICRO_BATCHES = 4
#: Entries that a task sums up before it hands them on.
COMBINED = 50_000
#: Shares that the rows of one id are dealt to where labels are joined by shuffle.
SALTS = 8
UPPER = bytes(range(65, 91))
SIGNS = re.compile(r"[#$%&*|]")
#: Rows of the table for each entry of the state, which holds what is known of the texts of one bucket of digests.
BUCKET_ROWS = 64
#: Shares of the state at most. A task that reads or follows the state tells the driver a metric for each share, so what the
#: driver gets grows as their square; their number follows the root of the table's, and this bounds the rest.
SHARES = 1000
#: How the stream's state is kept: on disk beyond memory, of each micro-batch only the changes are written to the shared folder,
#: and executors keep no state between the few micro-batches.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


class Text:
    """What the filters look at: the text, its UTF-8 bytes and its words."""

    def __init__(self, text: str):
        self.text, self.bytes = text, text.encode("utf-8", "surrogatepass")
        self.words = self.bytes.split()  # bytes.split parts at [\x20\x09-\x0D] alone


Filter = Callable[[Text], bool]
#: Letter and failure condition of each filter that a text decides alone.
FILTERS: dict[str, Filter] = {
    "A": lambda t: len(t.words) < 200,
    "B": lambda t: 100 * len(set(t.words)) < 50 * len(t.words),
    "C": lambda t: 100 * (len(t.bytes) - len(t.bytes.translate(None, UPPER))) > 3 * len(t.text),
    "D": lambda t: SIGNS.search(t.text) is not None,
}
#: Letter of the filter that fails copies of a text with a smaller id.
COPY = "E"


def _judged(filters: list[Filter]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, part, text) to id, part, key (a digest of the text) and mask (bits of the filters that fail it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text"):
            keys, masks = [], []
            for text in b.column(2).to_pylist():
                t = Text(text)
                keys.append(hashlib.blake2b(t.bytes, digest_size=16).hexdigest())
                masks.append(sum(1 << i for i, fails in enumerate(filters) if fails(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string()), pa.array(masks, pa.int32())], ["id", "part", "key", "mask"])

    return run


COMBINED_FIELDS = ("key", "part", "good", "toxic", "mask", "n", "least", "n_least")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up rows of one text, part and label within a task, so that a text of very many copies is a few rows of the shuffle.

    n rows, the least id among them and how many of the rows have it.  Rows without id are kept apart.
    """
    kinds = None

    def flush(found: dict) -> pa.RecordBatch:
        rows = [(k, p, g, t, m, *v) for (k, p, g, t, m, _), v in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(COMBINED_FIELDS))

    found: dict[tuple, list] = {}
    for b in batches:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), b.schema.field("id").type, pa.int64()]
        for i, *what in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", *COMBINED_FIELDS[:5]))):
            entry = found.get(at := (*what, i is None))
            if entry is None:
                found[at] = [1, i, 0 if i is None else 1]
            else:
                entry[0] += 1
                if i is not None and i < entry[1]:
                    entry[1:] = [i, 1]
                elif i is not None and i == entry[1]:
                    entry[2] += 1
        if len(found) >= COMBINED:
            yield flush(found)
            found = {}
    if found:
        yield flush(found)


class LeastIds(StatefulProcessor):
    """For each text the least id so far, and the rows that have it: the only ones that are no copies.

    Rows give changes of counters (part, good, toxic, mask, n).  When a smaller id arrives, the rows that were no copies
    until then are taken back from the mask without the bit of copies and are added to the one with it.  Texts are keyed by
    their digests; the state has an entry for each bucket of them, for each access to it costs a call: {digest: [least id,
    [[part, good, toxic, rows]]]} as JSON.
    """

    def __init__(self, bit: int):
        self.bit = bit

    def init(self, handle) -> None:
        self.state = handle.getValueState("texts", "texts string")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        before = self.state.get()
        texts = json.loads(before[0]) if before else {}
        deltas: dict[tuple, int] = {}
        changed = False

        def add(part: str, good: int, toxic: int, mask: int, n: int) -> None:
            deltas[part, good, toxic, mask] = deltas.get((part, good, toxic, mask), 0) + n

        for r in rows:
            _, text, part, good, toxic, mask, n, least, n_least = r
            copy = mask | self.bit
            if least is None:
                add(part, good, toxic, mask, n)
                continue
            known = texts.get(text)
            if known is None or least < known[0]:
                for *held, m in known[1] if known else ():
                    add(*held, mask, -m)
                    add(*held, copy, m)
                texts[text], changed = [least, [[part, good, toxic, n_least]]], True
            elif least == known[0]:
                mine = next((h for h in known[1] if h[:3] == [part, good, toxic]), None)
                if mine is None:
                    known[1].append([part, good, toxic, n_least])
                else:
                    mine[3] += n_least
                changed = True
            else:
                n_least = 0
            add(part, good, toxic, mask, n_least)
            add(part, good, toxic, copy, n - n_least)
        if changed:
            self.state.update((json.dumps(texts, ensure_ascii=False, separators=(",", ":")),))
        for (part, good, toxic, mask), n in deltas.items():
            if n:
                yield Row(part=part, good=good, toxic=toxic, mask=mask, n=n)

    def close(self) -> None:
        pass


def document_stream(spark: SparkSession, path: str, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """The rows of a parquet table as a stream of at most ``micro_batches`` micro-batches, none of its files left out for its age."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    if files and files[0].rsplit("/", 1)[-1] == (name := path.rstrip("/").rsplit("/", 1)[-1]):
        path = f"{path.rstrip('/')[: -len(name)]}{name[:-1]}[{name[-1]}]"  # streams take a folder or a pattern, not a file
    each = max(1, math.ceil(len(files) / micro_batches))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).option("maxFileAge", "36500d").parquet(path)


def state_shares(buckets: int) -> int:
    """Shares that the state of so many buckets is dealt to: about half the root of their number, so that the driver's metrics grow with the table."""
    return min(SHARES, 1 + math.isqrt(buckets) // 2)


def mask_counts(stream: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS, *, buckets: int = 1, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that fail them (bit i: the i-th filter, then that of copies).

    ``stream``: see :func:`document_stream`.  A null text is an empty one, a null part is "".  A row is a copy if a row with
    its text has a smaller id; a row without id never is one and makes none.  ``labels`` (doc_id, quality, toxic): a document
    is good or toxic if any of its rows says 1; good and toxic count only such documents.  The stream runs until all files
    that are there have been read; its state is an entry for each of ``buckets`` buckets of the texts, whose number should grow with
    the table, dealt to :func:`state_shares` tasks at most; its output is the changes of the counters, by micro-batch, in a folder that a repeated micro-batch writes
    again.  Ids are numbers or strings.
    """
    spark, kind, bit = stream.sparkSession, stream.schema[id_col].dataType.simpleString(), 1 << len(filters)
    short_batches(stream)
    folder = shared_dir(spark)
    rows = stream.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    judged = rows.mapInArrow(_judged(list(filters.values())), f"id {kind}, part string, key string, mask int")
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    one = written(one.withColumnRenamed("doc_id", "id"), "labels")
    if one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        labelled = judged.join(F.broadcast(one), "id", "left")
    else:  # an id of very many rows, or none, is dealt to several tasks by the text
        shares = one.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
        labelled = judged.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(shares, ["id", "salt"], "left")
    labelled = labelled.select("id", "key", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "mask")
    combined = labelled.mapInArrow(_combined, f"key string, part string, good int, toxic int, mask int, n long, least {kind}, n_least long")
    fields = "part string, good int, toxic int, mask int, n long"
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    deltas = combined.select(bucket, *COMBINED_FIELDS).groupBy("bucket").transformWithState(LeastIds(bit), fields, "update", "none")

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")

    spark.createDataFrame([], fields).write.parquet(f"{folder}/deltas/batch=-1")
    shares = min(int(spark.conf.get("spark.sql.shuffle.partitions")), state_shares(buckets))
    settings = STATE | {"spark.sql.shuffle.partitions": str(shares)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = deltas.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    counted = spark.read.schema(fields).parquet(f"{folder}/deltas").groupBy("part", "mask")
    return counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def interactions(counts: DataFrame, letters: str = "".join(FILTERS) + COPY) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order of ``letters``, from (part, mask, n, good, toxic).

    kept: after the step; removed: at it; redundant: failing its filter, but gone before; unique_fails: failing only its
    filter; good_lost and toxic_lost: of the removed; shapley: what its filter removes, over all orders, at any step.  A
    document that fails k filters is removed by each of them in the k-th part of all orders.  Every part has all steps.
    """
    orders = ["".join(p) for p in itertools.permutations(letters)]
    bits = {c: 1 << i for i, c in enumerate(letters)}
    steps = [{"filter_order": o, "step": s + 1, "bit": bits[o[s]], "before": sum(bits[c] for c in o[:s])} for o in orders for s in range(len(o))]
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2 ** letters of a part
    step = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")).alias("s")
    total = lambda value, where: F.expr(f"aggregate(masks, 0L, (a, m) -> a + IF({where}, {value}, 0L))")
    here = "m.mask & s.bit <> 0 AND m.mask & s.before = 0"
    return by_part.select("part", "masks", step).select(
        "part", "s.filter_order", "s.step",
        total("m.n", "m.mask & (s.bit | s.before) = 0").alias("kept"),
        total("m.n", here).alias("removed"),
        total("m.n", "m.mask & s.bit <> 0 AND m.mask & s.before <> 0").alias("redundant"),
        total("m.n", "m.mask = s.bit").alias("unique_fails"),
        total("m.good", here).alias("good_lost"),
        total("m.toxic", here).alias("toxic_lost"),
        total(f"m.n * CAST({len(orders)} / bit_count(m.mask) AS BIGINT)", "m.mask & s.bit <> 0").alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, filters: dict[str, Filter] = FILTERS, **columns: str) -> DataFrame:
    """How ``filters`` and the one for copies interact on the parquet table at ``path``, in every order; see :func:`interactions`.

    An empty table has no parts and so no rows.  Repeated rows each count; those that share the least id of a text are no
    copies of each other.
    """
    buckets = max(1, spark.read.parquet(path).count() // BUCKET_ROWS)  # the files' footers tell
    counts = written(mask_counts(document_stream(spark, path), labels, filters, buckets=buckets, **columns), "counts")
    return interactions(counts, "".join(filters) + COPY)
