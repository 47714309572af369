"""Token counts (operator 2)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import sub_batches

#: Distinct pieces whose counts a task remembers.
PIECE_CACHE = 500_000
#: Bytes that are handed to the tokenizer at a time.
BATCH_BYTES = 1 << 20
#: A piece starts where white space follows other characters: no token of a byte-level vocabulary crosses that place.
PIECE = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space and the tokenizers' patterns do not, so such texts stay whole.
ODD = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """Cut a text at safe boundaries; the pieces' token counts add up to the text's."""
    return [text] if ODD.search(text) else PIECE.findall(text)


def read_vocabulary(tokenizer_file: str) -> bytes:
    with open(tokenizer_file, "rb") as f:
        return f.read()


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class Counter(dict):
    """Token counts of pieces.  Pieces that are not remembered are encoded in batches of about equal bytes."""

    def __init__(self, tokenizer_file: str, content: bytes | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        content = read_vocabulary(tokenizer_file) if content is None else content
        if tokenizer_file.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.whole, self.encode = True, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_buffer(content)
            t.no_truncation()
            t.no_padding()
            # cutting into pieces is proven for byte-level pre-tokenizers without a prefix space and normaliser only
            self.whole = '"ByteLevel"' not in (s := str(t.pre_tokenizer and t.pre_tokenizer.__getstate__())) or '"add_prefix_space":true' in s.replace(" ", "") or t.normalizer is not None
            self.encode = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, wanted: list[str]) -> None:
        batch, size = [], 0
        for p in wanted:
            batch.append(p)
            size += n_bytes(p)
            if size >= BATCH_BYTES:
                self.update(zip(batch, self.encode(batch)))
                batch, size = [], 0
        self.update(zip(batch, self.encode(batch)))

    def counts(self, texts: list[str]) -> list[int]:
        if self.whole:
            out = []
            for t in texts:
                out += self.encode([t]) if t else [0]
            return out
        cut = [pieces(t) for t in texts]
        if len(self) > PIECE_CACHE:
            self.clear()
        self.learn(list({p for c in cut for p in c}.difference(self)))
        get = self.__getitem__
        return [sum(map(get, c)) for c in cut]


def count_tokens(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are kept, one row out for each row in;
    other columns are ignored.  There is no shuffle: lengths leave the Arrow function, tokens and texts do not.  The
    driver reads the vocabulary file (a few MB) and sends it to the tasks.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_file, content.value)
        for b in sub_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counter.counts([t or "" for t in b.column(1).to_pylist()]), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
