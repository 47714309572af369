"""Word files as a data source that opens only what a job has yet to do: a batch from a listing less a manifest, or a stream."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from casewright.functions.schemas import BLOCKS
from casewright.operators.scan import running_sums
from casewright.sources.word import blocks_of
from casewright.sources.work import shared_folder

#: Bytes of files that one task opens, and what opening one counts as.
TASK_BYTES, OPEN_BYTES = 256 << 20, 1 << 20
#: Bytes of files of one micro-batch.
BATCH_BYTES = 64 << 30
ARROW = pa.schema([("path", pa.string()), ("block_no", pa.int32()), ("kind", pa.string()), ("style", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))])
WORD = re.compile(r"(?i)\.docx$")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there; nothing in it is decoded."""
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    authority, _, inner = rest.removeprefix("//").partition("/")
    system, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}"


def file_blocks(paths: list[str]) -> Iterator[pa.RecordBatch]:
    """The blocks of each file, as BLOCKS; a file that cannot be read gives one block of kind "error" with the reason."""
    for path in paths:
        try:
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                found = blocks_of(f.read())
        except Exception as e:
            found = [{"kind": "error", "style": None, "level": None, "text": f"{type(e).__name__}: {e}", "cells": None}]
        if found:
            yield pa.RecordBatch.from_pylist([{"path": path, "block_no": i, **x} for i, x in enumerate(found)], ARROW)


@dataclass
class Bin(InputPartition):
    """The files of one task: by name, or as a part of the table of what is to do."""

    paths: list[str] | None = None
    table: str | None = None


class BinReader(DataSourceReader):
    def __init__(self, todo: str, bins: int):
        self.todo, self.bins = todo, bins

    def partitions(self) -> list[Bin]:
        return [Bin(table=f"{self.todo}/bin={i}") for i in range(self.bins)]

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(partition.table)
        parts = [f.path for f in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.path.endswith(".parquet")]
        for part in sorted(parts):
            for b in pq.ParquetFile(system.open_input_file(part)).iter_batches(1000, columns=["path"]):
                yield from file_blocks(b.column(0).to_pylist())


class FolderStream(DataSourceStreamReader):
    """New Word files of a folder, numbered by listings: each listing that finds some is written to ``log`` before it counts."""

    def __init__(self, folder: str, log: str, recursive: bool, batch_bytes: int):
        self.folder, self.log, self.recursive, self.batch_bytes = folder, log, recursive, batch_bytes

    def _logged(self) -> list[str]:
        system, inner = file_system(self.log)
        found = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
        return sorted((f.path for f in found if f.path.endswith(".json")), key=lambda p: int(os.path.basename(p)[:-5]))

    def _entry(self, path: str) -> list[list]:
        with file_system(self.log)[0].open_input_file(path) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        logged = self._logged()
        seen = {p for entry in logged for p, _ in self._entry(entry)}
        system, inner = file_system(self.folder)
        prefix = self.folder[: len(self.folder.rstrip("/")) - len(inner.rstrip("/"))]
        infos = system.get_file_info(pafs.FileSelector(inner, recursive=self.recursive))
        new = sorted((prefix + f.path, f.size) for f in infos if f.is_file and WORD.search(f.path) and not re.search(r"/[._]", f.path[len(inner) :]))
        new, taken = [x for x in new if x[0] not in seen], []
        for path, size in new:
            if taken and sum(s for _, s in taken) + size > self.batch_bytes:
                break
            taken.append((path, size))
        if not taken:
            return {"listing": len(logged)}
        system, inner = file_system(self.log)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/{len(logged) + 1}"
        with system.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps(taken).encode("utf-8", "surrogatepass"))
        system.move(f"{name}.tmp", f"{name}.json")
        return {"listing": len(logged) + 1}

    def partitions(self, start: dict, end: dict) -> list[Bin]:
        bins: list[list[str]] = []
        used = TASK_BYTES
        for entry in self._logged()[start["listing"] : end["listing"]]:
            for path, size in self._entry(entry):
                if used + size + OPEN_BYTES > TASK_BYTES:
                    bins.append([])
                    used = 0
                bins[-1].append(path)
                used += size + OPEN_BYTES
        return [Bin(paths=b) for b in bins] or [Bin(paths=[])]

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        return file_blocks(partition.paths)

    def commit(self, end: dict) -> None:
        pass


class WordFiles(DataSource):
    """``word_files``: BLOCKS of Word files.  Options of a batch: todo and bins; of a stream: path, log, recursive, batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "word_files"

    def schema(self) -> StructType:
        return BLOCKS

    def reader(self, schema: StructType) -> BinReader:
        return BinReader(self.options["todo"], int(self.options["bins"]))

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.options["path"], self.options["log"], self.options.get("recursive", "false") == "true", int(self.options.get("batchBytes", BATCH_BYTES)))


def numbered(files: DataFrame) -> DataFrame:
    """Adds doc_ord, the place by path, and bin: files in the order of their paths, so many that a bin has about TASK_BYTES.

    ``files``: path (once) and length.  Places and bytes are summed by ranges, so neither the driver nor a task sees all paths.
    """
    size = F.coalesce("length", F.lit(0)).cast("long") + OPEN_BYTES
    out = running_sums(files.withColumn("_all", F.lit(0)), ["_all"], ["path"], {"doc_ord": F.lit(1).cast("long"), "_bytes": size})
    return out.withColumn("bin", F.floor((F.col("_bytes") - size) / TASK_BYTES).cast("long")).drop("_all", "_bytes")


def read_listed(files: DataFrame) -> DataFrame:
    """BLOCKS of the Word files of a listing (path, bin), see :func:`numbered`; no other file is opened, and no bytes are shuffled."""
    spark = files.sparkSession
    spark.dataSource.register(WordFiles)
    todo = shared_folder(spark)
    bins = files.agg(F.max("bin")).first()[0]
    if bins is None:
        return spark.createDataFrame([], BLOCKS)
    files.select("path", "bin").repartition("bin").write.partitionBy("bin").parquet(todo)
    return spark.read.format("word_files").option("todo", todo).option("bins", bins + 1).load()


def stream_word_blocks(spark: SparkSession, folder: str, log: str, recursive: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """BLOCKS of the Word files that are new in ``folder`` since ``log``, a folder of this stream's own beside its checkpoint."""
    spark.dataSource.register(WordFiles)
    return spark.readStream.format("word_files").option("path", folder).option("log", log).option("recursive", str(recursive).lower()).option("batchBytes", batch_bytes).load()

