"""N-gram Jaccard join over prefix trees, and the groups that its links make (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.common import WordHashes, ascii_words, mix, remove, set_key, shingle_hashes, short_batches, small, sub_batches, written

#: Buckets, as a power of two, of the word counts by which shingles are ordered.
WORD_BITS = 18
#: Set elements of a block that one task joins at once; larger blocks are split.
BLOCK_ELEMENTS = 2_000_000
#: Sets of one label and size band that are compared by sketch, in parts of PART_ROWS; those of more common labels are taken as they are.
LABEL_ROWS, PART_ROWS = 20_000, 512
#: Words of sketches that are compared at once.
COMPARED_WORDS = 1 << 20
#: Sets that a task remembers so as not to send the elements of a copy again.
SEEN_SETS = 1 << 20
#: The largest weight of a word: twice the logarithm of 2**40.
MOST_WEIGHT = 80
#: Ids that are broadcast to pick out texts; with more of them all texts are shuffled once.
BROADCAST_IDS = 500_000
_LOW56 = np.uint64((1 << 56) - 1)


# --- sets in global order -------------------------------------------------------------------------------------------


def word_weights(docs: DataFrame) -> np.ndarray:
    """A byte for each bucket of word hashes that grows with the logarithm of the words counted there, over all texts.

    The sum over its words orders shingles from rare to common.  Any order gives the same links; a good one makes
    prefixes of shingles that few texts share, and puts passages that many texts share last.  The size is bounded.
    """
    bits = WORD_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(1 << bits, np.int64)
        for b in sub_batches(batches, "text"):
            words = [hashes.of(ascii_words(t)) for t in b.column(0).to_pylist()]
            total += np.bincount((np.concatenate(words) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = found.select("bucket", F.round(F.log2(F.col("n") + 1) * 2).cast("int").alias("weight")).toPandas()
    weights = np.zeros(1 << bits, np.uint8)
    weights[found.bucket.to_numpy(int)] = np.minimum(found.weight.to_numpy(int), MOST_WEIGHT)
    return weights


def ordered_set(words: np.ndarray, size: int, weights: np.ndarray) -> np.ndarray:
    """The keys of a text's distinct shingles, ascending: their weight in the first byte, then their hash."""
    h = shingle_hashes(words, size)
    if not len(h):
        return h
    w = weights[words >> np.uint64(64 - (len(weights) - 1).bit_length())].astype(np.uint64)
    k = min(size, len(words))
    total = sum((w[i : len(w) - k + 1 + i] for i in range(k)), np.zeros(len(h), np.uint64))
    return np.unique((total * np.uint64(127) // np.uint64(MOST_WEIGHT * k)) << np.uint64(56) | (mix(h) & _LOW56))


def needed(percent: int, n: int, m: int) -> int:
    """The smallest intersection of sets of n and m elements with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(percent: int, n: int) -> int:
    """Two linked sets have an element in common among their first so many."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch(keys: np.ndarray) -> bytes:
    """One bit for each bucket of a set's keys: whether it holds an odd number.  There are at least as many bits as keys.

    Where two sets' sketches differ, the sets do, so they differ in at least as many elements as the sketches in bits.
    """
    bits = max(128, 1 << (len(keys) - 1).bit_length())
    return np.packbits((np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of words, folded to ``size`` bytes; the parts of a folded one add up modulo 2."""
    return np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1, size // 8), axis=1)


def may_link(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Whether each set could be linked with another of these, judged by sizes and sketches; never false for one that is.

    Sketches of one length are compared with those of the same and of each greater length at once, in stretches of rows.
    """
    keep, length = np.zeros(len(sizes), bool), np.array([len(s) for s in sketches])
    kinds = {int(n): np.flatnonzero(length == n) for n in np.unique(length)}
    for n, a in kinds.items():
        mine = folded([sketches[i] for i in a], n)
        for m, b in kinds.items():
            if m < n:
                continue
            others = mine if m == n else folded([sketches[i] for i in b], n)
            step = max(1, COMPARED_WORDS // (len(b) * n // 8))
            for at in range(0, len(a), step):
                x, y = sizes[a[at : at + step], None], sizes[None, b]
                near = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (a[at : at + step, None] != b[None])
                if not near.any():
                    continue
                apart = np.bitwise_count(mine[at : at + step, None] ^ others[None]).sum(2, dtype=np.int64)
                near &= apart <= x + y - 2 * -(-percent * (x + y) // (100 + percent))
                keep[a[at : at + step]] |= near.any(1)
                keep[b] |= near.any(0)
    return keep


# --- the join of one block ------------------------------------------------------------------------------------------


class Node:
    """A stretch of keys that the sets below share, with what the bounds need."""

    __slots__ = ("keys", "children", "ends", "shortest", "longest", "member", "uniform")

    def __init__(self, keys: np.ndarray, member: int, size: int):
        self.keys, self.children, self.ends = keys, {}, []
        self.shortest = self.longest = size
        self.member, self.uniform = member, True


class Forest:
    """Which members are known to hang together."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def trie_join(sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Link, in ``forest``, all members whose sets are similar.

    The sets, common keys first, stand in a trie of stretches; members come in order of size.  Each is carried down the
    trie with its overlap so far, which all sets below share.  A subtree is left if even all that remains of both could
    not give the overlap that its smallest set needs, if its sets are too small, or if all of it hangs together with the
    member already, for then a further link changes no group.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [s[::-1] ^ np.uint64(0xFFFFFFFFFFFFFFFF) for s in sets]  # ascending again, common keys first
    top: dict[int, Node] = {}
    for i in order:
        own = sets[i]
        n = len(own)
        least = -(-percent * n // 100)
        stack = [(node, 0, 0, 0) for node in top.values()]
        while stack:
            node, overlap, used, depth = stack.pop()
            if node.longest < least or node.uniform and forest.root(node.member) == forest.root(i):
                continue
            need = needed(percent, n, max(node.shortest, least))
            if overlap + min(n - used, node.longest - depth) < need:
                continue
            keys = node.keys
            at = np.searchsorted(own, keys)
            at_in = np.minimum(at, n - 1)
            overlap += int(np.count_nonzero(own[at_in] == keys))
            used = int(np.searchsorted(own, keys[-1], "right"))
            depth += len(keys)
            if overlap + min(n - used, node.longest - depth) < need:
                continue
            for j in node.ends:
                if overlap >= needed(percent, n, len(sets[j])):
                    forest.join(i, j)
            stack += [(c, overlap, used, depth) for c in node.children.values()]
        insert(top, i, own, forest)


def insert(top: dict[int, Node], i: int, own: np.ndarray, forest: Forest) -> None:
    level, at, n = top, 0, len(own)
    while True:
        first = int(own[at])
        node = level.get(first)
        if node is None:
            node = level[first] = Node(own[at:], i, n)
            node.ends.append(i)
            return
        m = min(len(node.keys), n - at)
        differ = np.flatnonzero(node.keys[:m] != own[at : at + m])
        same = int(differ[0]) if len(differ) else m
        if same < len(node.keys):  # part the stretch
            low = Node(node.keys[same:], node.member, node.longest)
            low.children, low.ends, low.shortest, low.uniform = node.children, node.ends, node.shortest, node.uniform
            node.keys, node.children, node.ends = node.keys[:same], {int(low.keys[0]): low}, []
        node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
        node.uniform = node.uniform and forest.root(node.member) == forest.root(i)
        at += same
        if at == n:
            node.ends.append(i)
            return
        level = node.children


def block_links(ids: list[int], sets: list[np.ndarray], together: list[int], percent: int) -> list[tuple[int, int]]:
    """A link from each member to the smallest id of its group within the block; ``together`` are linked beforehand."""
    forest = Forest(len(ids))
    for i in together[1:]:
        forest.join(i, together[0])
    trie_join(sets, percent, forest)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        r = forest.root(i)
        least[r] = min(least.get(r, d), d)
    return [(d, least[forest.root(i)]) for i, d in enumerate(ids) if least[forest.root(i)] != d]


# --- Spark ----------------------------------------------------------------------------------------------------------


def linked_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that span each block of ``rows`` (block columns, no, keys, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, together = None, [], [], []

        def out():
            links = block_links(ids, sets, together, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in batches:
            lists = b.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (block, i, linked) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                if block != now:
                    if ids:
                        yield out()
                    now, ids, sets, together = block, [], [], []
                if ids and ids[-1] == i:  # repeated rows of one id
                    continue
                if linked:
                    together.append(len(ids))
                ids.append(i)
                sets.append(values[offsets[k] : offsets[k + 1]].copy())
        if ids:
            yield out()

    block = F.xxhash64(*[c for c in rows.columns if c not in ("no", "keys", "linked")])
    return rows.select(block.alias("block"), "no", "keys", "linked").repartition("block").sortWithinPartitions("block", "no").mapInArrow(run, "a long, b long")


def possible(labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(label, hi) of the sets in (label, hi, n) that could be linked with another of their label; see :func:`may_link`.

    Sets that are linked are of one or of neighbouring size bands.  Each set goes to its band and the next; where a label
    has many sets in a band, they are dealt in parts, and every two parts meet in a block.  ``sketches``: hi, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            keep = may_link(np.array([h[2] for h in held]), [h[3] for h in held], percent)
            kept = [h for h, k in zip(held, keep) if k]
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in kept], pa.int64()) for i in range(2)], ["label", "hi"])

        for b in batches:
            for block, *row in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    if len(held) > 1:
                        yield out()
                    now, held = block, []
                held.append(row)
        if len(held) > 1:
            yield out()

    width = max(math.log(100 / percent), 0.05) * (1 + 1e-6)  # a little more than the bound, for logarithms are rounded
    band = F.floor(F.log("n") / width).cast("int")
    banded = labels.select("label", "hi", "n", F.explode(F.array(band, band + 1)).alias("band"))
    counts = banded.groupBy("label", "band").agg(F.count("*").alias("k")).where("k > 1")
    banded = banded.join(counts, ["label", "band"])
    parts = F.ceil(F.col("k") / PART_ROWS).cast("int")
    usual = banded.where(F.col("k") <= LABEL_ROWS).withColumn("own", F.pmod(F.xxhash64("hi"), parts).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), parts - 1)))
    usual = usual.select(F.xxhash64("label", "band", F.least("own", "met"), F.greatest("own", "met")).alias("block"), "label", "hi", "n").join(sketches, "hi")
    found = usual.select("block", "label", "hi", "n", "sketch").repartition("block").sortWithinPartitions("block").mapInArrow(run, "label long, hi long")
    return found.unionByName(banded.where(F.col("k") > LABEL_ROWS).select("label", "hi")).distinct()


def hub_links(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (label, no, keys, hub_no, hub_keys) with ``linked``: whether the member is similar to its block's hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, hub = b.column(2), b.column(4)
            out = []
            for k in range(b.num_rows):
                x, y = (c.values.to_numpy(zero_copy_only=False)[c.offsets[k].as_py() : c.offsets[k + 1].as_py()] for c in (mine, hub))
                out.append(len(np.intersect1d(x, y, assume_unique=True)) >= needed(percent, len(x), len(y)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.bool_())], ["label", "no", "keys", "hub_no", "linked"])

    return rows.select("label", "no", "keys", "hub_no", "hub_keys").mapInArrow(run, "label long, no long, keys array<long>, hub_no long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches, by alternating stars.

    Every round hangs the larger neighbours of each id, then the smaller ones, on its smallest neighbour; the links that
    remain are stars around the smallest ids after a number of rounds that grows with the logarithm of the size.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        last, links = links, written(small_, "links")
        remove(last, large)
        after = mark(links)
        if after == before:
            break
        before = after
    return links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def near_groups(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id of every row of ``docs``.

    Words are lower-cased A-Z and parted by ASCII white space; a text's set is its distinct shingles of ``size`` words, or
    the whole sequence if that is shorter.  Texts link if 100 * intersection >= percent * union; component_id is the
    smallest id that links reach; ids are of any type that has an order.  Null, empty and wordless texts have no shingles
    and no links: their own id.  Equal sets are one set with many rows; repeated rows stay.  A row without id gets its
    set's component, or null.

    1. Words are counted in hash buckets over all texts; the counts order shingles, see :func:`word_weights`.
    2. Each text gives the key, the size and a sketch of its set, which are written.  Equal sets are one from here on.
    3. Each text gives the prefix of its set, once a task if the set comes again.  Sets that share a prefix element share
       a label: the smallest set key there.  An element in one set makes none.  This is the one shuffle of elements.
       Sizes and sketches show which of a label's sets could be linked at all, see :func:`possible`.
    4. Only those are built, from their texts; each goes once to the block of each of its labels.
       Blocks that are too large are first compared with one of their sets; what is linked with it needs no comparison
       with the like, so the rest meets all others in bounded parts.
    5. Blocks are joined by tries; links become components.
    """
    short_batches(docs)
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights = spark.sparkContext.broadcast(word_weights(rows))

    def ordered_sets(b: pa.RecordBatch, hashes: WordHashes) -> list[np.ndarray]:
        return [ordered_set(hashes.of(ascii_words(t)), size, weights.value) for t in b.column(1).to_pylist()]

    def lists(of: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in of])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(of).view(np.int64), pa.int64()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sub_batches(batches, "text"):
            sets = ordered_sets(b, hashes)
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n", "hi", "lo", "sketch"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in sub_batches(batches, "text"):
            his, elements = [], []
            for s in ordered_sets(b, hashes):
                if not len(s) or (hi := set_key(s)[0]) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(hi)
                elements.append(s[: prefix_length(percent, len(s))])
                his.append(np.full(len(elements[-1]), hi, np.int64))
            if his:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(his)), pa.array(np.concatenate(elements).view(np.int64))], ["hi", "element"])

    about = written(rows.mapInArrow(describe, f"id {kind}, n long, hi long, lo long, sketch binary"), "about")
    sets = about.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = written(sets.withColumn("no", F.monotonically_increasing_id()), "sets")

    at = Window.partitionBy("element")
    stars = rows.where("id IS NOT NULL").mapInArrow(prefixes, "hi long, element long").select("hi", F.min("hi").over(at).alias("label"), F.max("hi").over(at).alias("other"))
    labels = written(stars.where("label <> other").select("hi", "label").distinct().join(sets.select("hi", "n"), "hi"), "labels")
    wanted = written(possible(labels, sets.select("hi", "sketch"), percent).join(sets.select("hi", "no", "id", "n"), "hi"), "wanted")
    remove(labels)
    load = written(wanted.groupBy("label").agg(F.sum("n").alias("elements"), F.min("no").alias("hub_no")).where(F.col("elements") > BLOCK_ELEMENTS).select("label", "hub_no"), "load")
    large = small(load)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in sub_batches(batches, "text"):
            found, fresh = ordered_sets(b, hashes), []
            for s, hi, no in zip(found, b.column(2).to_pylist(), b.column(3).to_pylist()):
                fresh.append(len(s) > 0 and set_key(s)[0] == hi and no not in seen)  # an id may have other texts beside
                if fresh[-1]:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(no)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), lists(found)], ["no", "labels", "keys"]).filter(pa.array(fresh, pa.bool_()))

    def members(of: DataFrame) -> DataFrame:
        """(no, keys, label): the sets of (label, hi, no, id), built from their texts once and given to each label."""
        listed = of.groupBy("id", "hi", "no").agg(F.collect_list("label").alias("labels"))
        chosen = rows.join(small(of.select("id").distinct(), BROADCAST_IDS), "id", "left_semi")  # so that other texts are not shuffled
        built = chosen.join(listed, "id").select("id", "text", "hi", "no", "labels").mapInArrow(build, "no long, labels array<long>, keys array<long>")
        return built.select("no", "keys", F.explode("labels").alias("label"))

    links = linked_pairs(members(wanted.join(large, "label", "left_anti")).select("label", "no", "keys", F.lit(False).alias("linked")), percent)
    scratch = [wanted, load]
    if not load.isEmpty():
        held = written(members(wanted.join(large, "label", "left_semi")).dropDuplicates(["label", "no"]).join(large, "label"), "members")
        hubs = held.where("no = hub_no").select("label", F.col("keys").alias("hub_keys"))
        near = hub_links(held.where("no <> hub_no").join(hubs, "label"), percent).unionByName(held.where("no = hub_no").select("label", "no", "keys", "hub_no", F.lit(True).alias("linked")))
        near = written(near, "near")
        remove(held)
        parts = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, F.size("keys"))), F.lit(0)) / BLOCK_ELEMENTS * 2).cast("int")
        split = near.groupBy("label").agg(parts(F.col("linked")).alias("n1"), parts(~F.col("linked")).alias("n0")).where("n0 > 0")
        dealt = near.join(split, "label").withColumn("own", F.pmod(F.xxhash64("no"), F.when(F.col("linked"), F.col("n1")).otherwise(F.col("n0"))).cast("int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        same = dealt.where("linked").select("label", F.col("own").alias("p1"), every(F.col("n0")).alias("p0"), "no", "keys", "linked")
        rest = dealt.where("NOT linked").select("label", every(F.greatest("n1", F.lit(1))).alias("p1"), F.col("own").alias("p0"), "no", "keys", "linked")
        between = dealt.where("NOT linked AND n0 > 1").select("label", "own", every(F.col("n0")).alias("q"), "no", "keys", "linked").where("q <> own")
        between = between.select("label", (-1 - F.least("own", "q")).alias("p1"), F.greatest("own", "q").alias("p0"), "no", "keys", "linked")
        links = links.unionByName(near.where("linked AND no <> hub_no").select(F.col("no").alias("a"), F.col("hub_no").alias("b"))).unionByName(linked_pairs(same.unionByName(rest).unionByName(between), percent))
        scratch.append(near)

    reached = components(links)
    reached = reached.unionByName(reached.select(F.col("component").alias("id"), "component").distinct())
    reached = written(reached.join(sets.select(F.col("no").alias("id"), F.col("id").alias("own")), "id"), "reached")
    remove(*scratch)
    first = reached.groupBy("component").agg(F.min("own").alias("first"))
    named = reached.join(first, "component").select(F.col("id").alias("no"), "first")
    found = sets.select("hi", "lo", "no", "id").join(named, "no", "left").select("hi", "lo", F.coalesce("first", "id").alias("component"))
    full = about.where("n > 0").select("id", "n", "hi", "lo").join(found, ["hi", "lo"], "left").select("id", "n", "component")
    out = full.unionByName(about.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
