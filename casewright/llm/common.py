"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has no more rows than this; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 50_000
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: Words whose hashes a task remembers; the memory is emptied when it is full.
WORD_CACHE = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables, below the folder that all executors share.

    That is ``spark.checkpoint.dir``.  Where it is unset, a local master gets a temporary folder, and a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="casewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/casewright-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again: what came from them has been written."""
    for df in tables:
        files, jvm = df.inputFiles(), df.sparkSession.sparkContext._jvm
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def short_batches(df: DataFrame) -> None:
    """Let Arrow batches of the session have BATCH_ROWS rows at most from here on, for rows hold whole texts.

    Spark bounds them by bytes as well (spark.sql.execution.arrow.maxBytesPerBatch), so that long texts make short batches.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be within ``limit`` rows, otherwise ``df`` as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class WordHashes(dict):
    """64-bit hashes of words, each computed once as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift, wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; one for the whole sequence where it is shorter; none for none."""
    n = len(words)
    k = min(n, size)
    if not k:
        return words
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h ^ words[i : n - k + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    return h


def set_key(sorted_hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    d = xxhash.xxh3_128_digest(sorted_hashes.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``column``, or a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        start = total = 0
        for i, n in enumerate(lengths(b, column)):
            if i > start and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)


def lengths(b: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
