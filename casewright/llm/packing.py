"""Best-fit packing of token sequences by patterns (operator 12)."""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import sub_batches, written
from casewright.llm.token_count import Counter, read_vocabulary
from casewright.operators.scan import running_sums

#: By byte: whether it is ASCII white space, and whether an ASCII letter.
SPACE, LETTER = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\x0b\x0c\r ", string.ascii_letters.encode()))
#: Distinct pieces whose ids a task remembers.
PIECE_CACHE = 1_000_000
#: Pieces of text that are longer are not remembered.
LONG = 64
#: Pieces that are encoded as one text.
BESIDE = 2000
#: Bytes of text whose pieces are told apart together.
TOGETHER = 8 << 20
#: Rounds of the fit, and patterns that may enter in one.
ROUNDS, ENTER = 40, 256


def piece_starts(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 bytes: at one of ``stops`` after a letter, and at white space among them after what is none.

    ``stops`` are ASCII characters but letters.  No byte-level token crosses these places.  After U+0080 to U+00BF, U+0800
    to U+303F, and U+E000 and above, some of which are white space, no piece starts.
    """
    at = np.flatnonzero(stops[data])
    one, two, three = (data.take(at - k, mode="clip") for k in (1, 2, 3))  # bytes from 0xC2 are the first ones of characters
    letter = LETTER[one] | (two == 0xC3) & (one != 0x97) & (one != 0xB7)  # U+00C0 to U+00FF but the two signs among them
    solid = (one > 0x20) & (one < 0x7F) | (two >= 0xC3) & (two <= 0xDF) | (three >= 0xE4) & (three <= 0xED) | (three == 0xE3) & (two > 0x80)
    return at[letter | solid & SPACE[data[at]]]


class Ids(Counter):
    """The ids of texts as little-endian unsigned 32-bit integers; pieces of text are encoded once as long as they are remembered.

    NumPy cuts the texts and Arrow finds the distinct pieces, so that Python handles each once however often it occurs.
    Pieces that are not remembered are encoded as one text where they may stand side by side, and cut apart by the bytes of
    their tokens.  What was used since half of the memory was filled stays remembered when the other half is.
    """

    def __init__(self, tokenizer_file: str, content: bytes):
        super().__init__(tokenizer_file, content)
        self.before: dict[str, bytes] = {}
        if tokenizer_file.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda texts: [np.array(x, "<u4").tobytes() for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_buffer(content)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda texts: [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(texts, add_special_tokens=False)]
            own = t.get_added_tokens_decoder()
            self.whole |= any(a.rstrip or a.single_word for a in own.values())  # these look at what follows
            # what added tokens hold is no stop, for they may be found anywhere
            self.stops = ~LETTER & ~np.isin(np.arange(256), [*range(128, 256), *"".join(a.content for a in own.values()).encode()])
            added = {i: len(a.content.encode()) for i, a in own.items()}
            sizes = {i: len(token) for token, i in t.get_vocab().items()} | added  # a character of a byte-level token is a byte
            self.bytes_of = np.zeros(max(sizes) + 1, np.int64)
            self.bytes_of[list(sizes)] = list(sizes.values())

    def learn(self, wanted: list[str]) -> None:
        beside = [p for p in wanted if p[:1].isspace() and not p[-1].isspace()]
        super().learn(list(set(wanted).difference(beside)))
        for i in range(0, len(beside), BESIDE):
            some = beside[i : i + BESIDE]
            raw = self.encode(["".join(some)])[0]
            ends = np.cumsum(self.bytes_of[np.frombuffer(raw, "<u4")])
            cuts = np.cumsum(list(map(len, map(str.encode, some))))
            at = np.searchsorted(ends, cuts)
            if at[-1] >= len(ends) or (ends[at] != cuts).any():
                super().learn(some)
                continue
            stops = (4 * (at + 1)).tolist()
            self.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops))))

    def of(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [self.encode([t])[0] if t else b"" for t in texts]
        _, offsets, data = pa.array(texts, pa.large_string()).buffers()
        rows = np.frombuffer(offsets, np.int64, len(texts) + 1)
        starts = np.zeros(rows[-1] + 1, bool)
        starts[piece_starts(np.frombuffer(data or b"", np.uint8, rows[-1]), self.stops)] = True
        starts[rows] = True
        cuts = np.flatnonzero(starts)
        cut = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        distinct, nth = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        if len(self) > PIECE_CACHE // 2:
            self.before = dict(self)
            self.clear()
        found = list(map(self.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        self.update((p, self.before[p]) for p in map(distinct.__getitem__, missing) if p in self.before)
        new = [p for p in map(distinct.__getitem__, missing) if p not in self]
        self.learn(new)
        for i in missing:
            found[i] = self[distinct[i]]
        for p in new:
            if len(p) > LONG:
                del self[p]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = (np.cumsum(size) - size)[nth], size[nth]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        stops = (4 * ends[np.searchsorted(cuts, rows)]).tolist()
        return list(map(ids.__getitem__, map(slice, stops, stops[1:])))


#: Of a worker's tasks the latest vocabulary with its pieces.
_latest: dict[bytes, Ids] = {}


def _ids(tokenizer_file: str, content: bytes) -> Ids:
    key = hashlib.sha256(content).digest()
    if key not in _latest:
        _latest.clear()
        _latest[key] = Ids(tokenizer_file, content)
    return _latest[key]


def token_pieces(docs: DataFrame, tokenizer_file: str, *, end: int = 2, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, piece, start, length and ids_crc32: each text's ids and ``end``, cut into ``limit`` ids where there are more.

    The first piece of a longer text takes what is over, so all others are full.  A null text is an empty one.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_file))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer_file, content.value)
        for b in sub_batches(batches, "text", TOGETHER):
            row, number, start, length, crc = [], [], [], [], []
            for i, got in enumerate(ids.of([t or "" for t in b.column(1).to_pylist()])):
                whole = memoryview(got + last)
                n, at, k = len(whole) // 4, 0, 0
                while at < n:
                    size = (n - at) % limit or limit
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(whole[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long")


def exact_patterns(counts: np.ndarray) -> np.ndarray:
    """All pairs and triples of lengths that occur and fill a sequence: rows of three lengths, descending, 0 where there is none."""
    limit = len(counts) - 1
    have = counts > 0
    found = []
    for a in np.flatnonzero(have[:limit]):
        if 2 * a >= limit and have[limit - a]:
            found.append(np.array([[a, limit - a, 0]]))
        b = np.arange(max(1, (limit - a + 1) // 2), min(a, limit - a - 1) + 1)  # c = limit - a - b <= b <= a
        b = b[have[b] & have[limit - a - b]]
        if len(b):
            found.append(np.column_stack([np.full(len(b), a), b, limit - a - b]))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats of the patterns, by non-negative least squares, so that together they come near to ``counts``.

    Patterns along which the misfit falls most enter in blocks; what the least squares of those that are in would repeat
    less than not at all leaves again.  At the end few more patterns than lengths are in.
    """
    target = counts.astype(float)
    target[0] = 0
    chosen, x = np.zeros(0, np.int64), np.zeros(0)
    best, best_misfit = np.zeros(len(patterns)), float(target @ target)
    misfit = target.copy()
    for _ in range(ROUNDS):
        misfit[0] = 0
        gain = misfit[patterns].sum(axis=1)
        gain[chosen] = 0
        used, enter = set(), []
        for p in np.argsort(-gain)[: 16 * ENTER]:
            if gain[p] <= 1e-6 * max(1.0, target.max()) or len(enter) == ENTER:
                break
            own = set(patterns[p].tolist()) - {0}
            if not own & used:
                used |= own
                enter.append(p)
        if not enter:
            break
        chosen = np.concatenate([chosen, np.array(enter)])
        while True:
            a = np.zeros((len(target), len(chosen)))
            for j in range(3):
                np.add.at(a, (patterns[chosen, j], np.arange(len(chosen))), 1.0)
            a[0] = 0
            x = np.linalg.solve(a.T @ a + 1e-6 * np.eye(len(chosen)), a.T @ target)
            if not len(chosen) or x.min() > 0:
                break
            chosen = chosen[x > 0]
        misfit = target - a @ x
        if (now := float(misfit @ misfit)) < best_misfit:
            best, best_misfit = np.zeros(len(patterns)), now
            best[chosen] = x
    return best


def best_fit(left: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns and repeats of best fit decreasing: lengths from the largest, each into the smallest gap that takes it.

    Sequences with the same lengths are handled together, so the work depends on the lengths there are, not on documents.
    """
    limit = len(left) - 1
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    open_gaps = np.zeros(limit + 1, bool)
    done: list[tuple[list[int], int]] = []

    def put(items: list[int], gap: int, n: int) -> None:
        if n and gap:
            gaps.setdefault(gap, []).append((items, n))
            open_gaps[gap] = True
        elif n:
            done.append((items, n))

    for v in range(limit, 0, -1):
        todo = int(left[v])
        while todo:
            fits = np.flatnonzero(open_gaps[v:])
            gap = v + int(fits[0]) if len(fits) else limit
            items, n = gaps[gap].pop() if len(fits) else ([], todo)
            if len(fits) and not gaps[gap]:
                open_gaps[gap] = False
            each = gap // v  # what is left of the gap is the smallest one for the next of this length
            whole = min(n, todo // each)
            put(items + [v] * each, gap - v * each, whole)
            todo -= whole * each
            if whole < n:
                rest = min(todo, each)  # fewer than would fill one more, or no sequence is left over
                if rest:
                    put(items + [v] * rest, gap - v * rest, 1)
                    todo -= rest
                if items:
                    put(items, gap, n - whole - (1 if rest else 0))
    return done + [x for found in gaps.values() for x in found]


def packing_plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths, descending) and repeats that take just ``counts[l]`` of each length l; full lengths alone.

    Exact pairs and triples are repeated as fitted, as far as there are lengths left, and the rest goes by best fit.  Of
    repeats rounded to the nearest, rounded down, and none, those are taken that need the fewest sequences: with few
    documents a fit leaves too little to fill gaps with.
    """
    counts = counts.astype(np.int64)
    limit = len(counts) - 1
    full = [([limit], int(counts[limit]))] if counts[limit] else []
    rest = counts.copy()
    rest[limit] = 0
    patterns = exact_patterns(rest)
    x = fit(patterns, rest) if len(patterns) else np.zeros(0)
    plans = []
    for repeats in (np.rint(x), np.floor(x), np.zeros(len(x))):
        left, plan = rest.copy(), []
        for p in np.argsort(-x, kind="stable"):
            items = [int(v) for v in patterns[p] if v]
            n = min(int(repeats[p]), *(int(left[v]) // items.count(v) for v in items))
            if n > 0:
                plan.append((items, n))
                for v in items:
                    left[v] -= n
            elif repeats[p] < 1:
                break
        plans.append(plan + best_fit(left))
    return full + min(plans, key=lambda plan: sum(n for _, n in plan))


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: (first rank, repeats, first sequence, offset) of the pieces that each pattern takes of it, by rank."""
    rank: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for items, n in plan:
        at = 0
        for v in sorted(set(items), reverse=True):
            out.setdefault(v, []).append((rank.get(v, 0), n, sequence, at))
            rank[v] = rank.get(v, 0) + n * items.count(v)
            at += v * items.count(v)
        sequence += n
    return {v: np.array(rows, np.int64) for v, rows in out.items()}


def pack(docs: DataFrame, tokenizer_file: str, *, end: int = 2, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row; see :func:`token_pieces`.

    Only a histogram of at most ``limit`` lengths reaches the driver, which plans on it and sends the plan back: a few
    rows for each pattern.  Pieces are numbered within their length, by ranges, so that a length that most pieces have is
    no single task, and a piece's number tells its sequence and place.  Repeated rows and null ids are packed as any others;
    no rows give none.
    """
    found = token_pieces(docs, tokenizer_file, end=end, limit=limit, id_col=id_col, text_col=text_col)
    found = written(found.withColumn("tie", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    slots = docs.sparkSession.sparkContext.broadcast(_slots(packing_plan(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy() - 1
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                rows = slots.value[int(v)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + nth % row[:, 1]
                offset[mine] = row[:, 3] + nth // row[:, 1] * v
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names)

    numbered = running_sums(found, ["length"], ["doc", "piece", "tie"], {"rank": F.lit(1).cast("long")}, ("tie",), written)
    kind = docs.schema[id_col].dataType.simpleString()
    placed = numbered.select("doc", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc", id_col)
