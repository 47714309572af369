"""Benchmark decontamination by SimHash windows (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import WordHashes, mix, remove, shingle_hashes, short_batches, small, sub_batches, written

#: Words of a shingle, and the similarity from which a window holds an item.
SHINGLE, SIMILAR = 5, 0.8
#: Of what is similar, each holds at least two thirds of the other's weight, so a window lacks no more than this share of an item.
LOST = (2 - 2 * SIMILAR) / (2 - SIMILAR)
#: Bits of a fingerprint, its blocks, and the Hamming radius within which all fingerprints are found.
BITS, BLOCKS, RADIUS = 64, 8, 23
#: Benchmark items, and bytes of their texts, that are held at a time; a larger benchmark is searched in such slices.
SLICE_ITEMS, SLICE_BYTES = 20_000, 32 << 20
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GATE_BITS, _WIDE_GATE_BITS = 20, 27
#: Starts of windows, and pairs of windows and items, that are compared at once.
_STARTS, _PAIRS = 4096, 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, in lower case; what ASCII has besides parts words."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def hash_bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def simhash(h: np.ndarray, weight: np.ndarray) -> np.uint64:
    return np.packbits(weight @ hash_bits(h) > 0).view(np.uint64)[0]


def window_prints(h: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints of all windows of ``size`` shingles, from running sums; :func:`simhash` of each."""
    sums = np.zeros((len(h) + 1, BITS), np.float64)
    np.cumsum(hash_bits(h) * weight[:, None], axis=0, dtype=np.float64, out=sums[1:])
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1).view(np.uint64).ravel()


def simple_shingles(hashes: np.ndarray, letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of every shingle, in order; a shingle weighs as many letters as it has."""
    h = shingle_hashes(hashes, size)
    k = min(size, len(hashes))
    ends = np.concatenate([[0], np.cumsum(letters)])
    return h, (ends[k:] - ends[:-k]).astype(np.float32) if k else np.empty(0, np.float32)


class Matcher:
    """A slice of the benchmark: the items of each shingle, and their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        hashes = WordHashes()
        self.ids, self.sets, self.length, self.slack, prints = [], [], [], [], []
        gate: dict[int, list[tuple[int, int]]] = {}
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            h, weight = simple_shingles(hashes.of(w), np.array([len(x) for x in w]), SHINGLE)
            n = len(self.ids)
            self.ids.append(item)
            self.length.append(len(w))
            self.sets.append(dict(zip(h.tolist(), weight.tolist())))
            self.slack.append(tuple(int(np.searchsorted(np.cumsum(x), LOST * x.sum(), "right")) + 1 for x in (weight, weight[::-1])))
            prints.append(simhash(h, weight))
            for at, x in enumerate(h.tolist()):
                gate.setdefault(x, []).append((n, at))
        self.gate = gate
        self.known = np.zeros(1 << _GATE_BITS, bool)
        self.known[np.fromiter(gate, np.uint64, len(gate)) >> np.uint64(64 - _GATE_BITS)] = True
        self.sizes = sorted({min(SHINGLE, n) for n in self.length})
        self.prints = np.array(prints, np.uint64)

    def within_radius(self, fingerprints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within RADIUS.  Of BLOCKS blocks at least one differs in no more than its
        share of the radius; only where one does are all bits compared.
        """
        apart = fingerprints[:, None] ^ self.prints[items][None]
        by_block = np.bitwise_count(apart.view(np.uint8)).reshape(*apart.shape, BLOCKS)
        window, item = np.nonzero((by_block <= RADIUS // BLOCKS).any(2))
        near = by_block[window, item].sum(1) <= RADIUS
        return window[near], items[item[near]]

    def stretches(self, h: np.ndarray, size: int, n_words: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first start, last start, words, items) of the item-sized windows that could hold an item.

        A window without a shingle of an item has similarity 0 to it, so only windows around such shingles are
        fingerprinted: of the item's size, from the first to the last start that puts one of them in its place, and so far
        beyond as an item can lose shingles at its ends (see LOST).  For the same reason only items with a shingle in
        reach are compared with them.
        """
        starts: dict[int, list[int]] = {}
        places, held = [], []
        for p in np.flatnonzero(self.known[h >> np.uint64(64 - _GATE_BITS)]).tolist():
            for n, at in self.gate.get(int(h[p]), ()):
                if min(SHINGLE, self.length[n]) == size:
                    starts.setdefault(n, []).append(p - at)
                    places.append(p)
                    held.append(n)
        items = np.array(held, np.int64)
        spans: set[tuple[int, int, int]] = set()
        for n, s in starts.items():
            length = self.length[n]
            s = sorted(set(s))
            first = last = s[0]
            for x in [*s[1:], None]:
                if x is not None and x - last <= length:
                    last = x
                    continue
                lead, trail = self.slack[n]
                lo, hi = (min(max(0, y), max(0, n_words - length)) for y in (first - trail, last + lead))
                spans.add((lo, hi, length))
                first = last = x
        for lo, hi, length in sorted(spans):
            near = slice(np.searchsorted(places, lo, "left"), np.searchsorted(places, hi + length, "right"))
            yield lo, hi, length, np.unique(items[near])

    def leaks(self, words: list[bytes], hashes: WordHashes) -> dict[int, tuple[float, int, int]]:
        """For each item found in a text: the best similarity, the window's first word and its words."""
        found: dict[int, tuple[float, int, int]] = {}
        if not words or not self.ids:
            return found
        w = hashes.of(words)
        letters = None
        for size in self.sizes:
            if len(w) < size:
                continue
            h = shingle_hashes(w, size)
            if not self.known[h >> np.uint64(64 - _GATE_BITS)].any():
                continue
            if letters is None:
                letters = np.fromiter(map(len, words), np.int64, len(words))
            h, weight = simple_shingles(w, letters, size)
            for first, last, length, items in self.stretches(h, size, len(w)):
                n = max(1, min(length, len(w)) - size + 1)
                for lo in range(first, last + 1, _STARTS):
                    hi = min(last, lo + _STARTS - 1)
                    prints = window_prints(h[lo : hi + n], weight[lo : hi + n], n)
                    step = max(1, _PAIRS // max(1, len(prints)))
                    for at in range(0, len(items), step):
                        self.verify(found, h, weight, lo, n, min(length, len(w)), *self.within_radius(prints, items[at : at + step]))
        return found

    def verify(self, found: dict, h: np.ndarray, weight: np.ndarray, lo: int, size: int, n_words: int, window: np.ndarray, item: np.ndarray) -> None:
        """Put what is similar of (window, item) into ``found``: the greatest similarity of an item, then the first window."""
        now, own, total = -1, {}, 0.0
        for k, n in zip(window.tolist(), item.tolist()):
            if k != now:
                part = slice(lo + k, lo + k + size)
                now, own = k, dict(zip(h[part].tolist(), weight[part].tolist()))
                total = sum(own.values())
            own_item = self.sets[n]
            both = sum(x for s, x in own_item.items() if s in own)
            alike = 2 * both / (total + sum(own_item.values()))
            best = found.get(self.ids[n], (0.0, 0, 0))
            if alike >= SIMILAR and (alike, -lo - k) > (best[0], -best[1]):
                found[self.ids[n]] = (alike, lo + k, n_words)


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Matcher]:
    """The benchmark in slices of bounded size, dealt by a hash of the item; one at a time."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // (SLICE_ITEMS // 2)) if n > SLICE_ITEMS else 1, -(-size // (SLICE_BYTES // 2)) if size > SLICE_BYTES else 1)
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield Matcher([tuple(r) for r in own.orderBy("id", "text").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, item_id, similarity, first_word and n_words: one row for each item that a row of ``docs`` holds.

    Windows as long as an item are fingerprinted by SimHash over weighted shingles; all fingerprints of items within
    RADIUS are found by blocks, and the exact weighted similarity (twice the common weight over the weight of both)
    decides at SIMILAR.  Null, empty and wordless texts and items hold nothing and are held by nothing; a text shorter
    than an item is one window; repeated rows give repeated results; rows with null ids are searched like others.

    A benchmark of one slice is searched in one pass.  With more, a first pass keeps the texts that hold a shingle of any
    item (a bit for each bucket of hashes), and each slice, one held at a time, searches those.
    """
    short_batches(docs)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def searched(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in sub_batches(batches, "text"):
                at, out = [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    for item, x in sorted(shared.value.leaks(words_of(text), hashes).items()):
                        at.append(k)
                        out.append((item, *x))
                if at:
                    cols = list(zip(*out))
                    ids = b.column(0).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in cols)], ["id", "item_id", "similarity", "first_word", "n_words"])

        return rows.mapInArrow(run, f"id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long")

    of_slices = slices(benchmark)
    first = next(of_slices)
    second = next(of_slices, None)
    if second is None:
        return searched(rows, spark.sparkContext.broadcast(first)).withColumnRenamed("id", id_col)
    del first, second, of_slices
    gate, sizes = np.zeros(1 << _WIDE_GATE_BITS >> 3, np.uint8), set()
    for m in slices(benchmark):
        at = np.fromiter(m.gate, np.uint64, len(m.gate)) >> np.uint64(64 - _WIDE_GATE_BITS)
        np.bitwise_or.at(gate, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        sizes.update(m.sizes)
    wide = spark.sparkContext.broadcast((gate, sorted(sizes)))

    def gated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (bits, sizes) = WordHashes(), wide.value
        for b in sub_batches(batches, "text"):
            keep = []
            for text in b.column(1).to_pylist():
                w = hashes.of(words_of(text))
                at = np.concatenate([shingle_hashes(w, n) for n in sizes if len(w) >= n] or [w[:0]]) >> np.uint64(64 - _WIDE_GATE_BITS)
                keep.append(bool((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).any()))
            yield b.filter(pa.array(keep, pa.bool_()))

    met, results = written(rows.mapInArrow(gated, f"id {kind}, text string"), "gated"), []
    for m in slices(benchmark):
        shared = spark.sparkContext.broadcast(m)
        results.append(written(searched(met, shared), "found"))
        shared.destroy()
    remove(met)
    return reduce(DataFrame.unionByName, results).withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all columns; see :func:`find_leaks`.

    Texts that hold one are few: they are told by 128 bits of their hashes, and dropped by an anti join, with the list
    sent to all tasks if it is counted to be short.
    """
    key = F.struct(F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), text_col).alias("h2"))
    leaky = find_leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, id_col="key")
    leaky = small(written(leaky.select("key").distinct(), "leaky"))
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(leaky, "key", "left_anti").select("row.*")
