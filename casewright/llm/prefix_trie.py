"""Prefix trie of conversations by whole-sequence collapse (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import written
from casewright.operators.scan import running_sums

#: Keys with more than this part of all rows of a join are sent to all tasks; there are no more than so many.
HOT_KEYS = 10_000
#: Ids that a task joins to one text before they are hashed in order.
CHUNK = 4096
SUMS = ["s0", "s1", "s2", "s3"]
ADDS = ["w0", "w1", "w2", "w3"]
PARENT = ["p0", "p1", "p2", "p3"]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: Column, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and tells by ``size`` how many rows have it.

    Sizes add up to ``total``, so at most HOT_KEYS keys have more than a HOT_KEYS-th of it: these are broadcast, the
    others are joined by shuffle.
    """
    hot = F.coalesce(size, F.lit(0)) > total // HOT_KEYS + 1000
    few = F.broadcast(table.where(hot))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(table.where(~hot), keys))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of their block's first one: (conv_id, depth, digest, n_chars) and (conv_id, n_turns).

    Conversation c gets the first h turns of c - c % block (all if there are fewer, none if it is absent), then its own
    turns after its first h; h = crc32(decimal c) % most.  Turns stand in order of turn, role and text, nulls first; null
    roles and texts are empty; repeated rows stay.  Rows without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumns({"digest": digest, "n_chars": F.char_length("text").cast("long")})
    turns = written(running_sums(rows, ["conv_id"], ["turn", "role", "text", "tie"], {"pos": F.lit(1).cast("long")}, ("turn", "role", "text", "tie"), written), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % most, "base": F.col("conv_id") - F.col("conv_id") % block})
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    about = own.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    about = written(about.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "about")
    opening = turns.where(F.col("pos") < most).where(F.col("conv_id") % block == 0).withColumnRenamed("conv_id", "base")
    given = opening.join(about.select("conv_id", "base", "taken"), "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "n_chars")
    total = about.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = lookup(turns, about.select("conv_id", "h", "taken", "n"), ["conv_id"], F.col("n"), total).where("pos > h")
    kept = kept.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "n_chars")
    return written(given.unionByName(kept), "rebuilt"), about.select("conv_id", "n_turns")


def end_digests(members: DataFrame, keys: list[str], id_col: str = "conv_id") -> DataFrame:
    """keys and ends_sha256: SHA-256 of each group's ids, as decimals in ascending order, joined by commas.

    Ids are dealt in ranges of (keys, id) and joined to texts of CHUNK ids there; a group's hash, which has to see its ids
    in order, is fed with these texts as they come, so no task holds a group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    n = len(keys)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema.names)

    kind = pa.schema([(k, pa.int64()) for k in keys])
    chunked, hashed = pa.schema([*kind, ("first", pa.int64()), ("ids", pa.string())]), pa.schema([*kind, ("ends_sha256", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for row in rows_of(batches):
            if ids and (row[:n] != key or len(ids) == CHUNK):
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = row[:n]
            ids.append(row[n])
            if len(out) == 1000:
                yield batch(out, chunked)
                out = []
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        if out:
            yield batch(out, chunked)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for row in rows_of(batches):
            if row[:n] == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = row[:n], hashlib.sha256()
            sha.update(row[n + 1].encode())
            if len(out) == 1000:
                yield batch(out, hashed)
                out = []
        if key is not None:
            out.append((*key, sha.hexdigest()))
            yield batch(out, hashed)

    texts = members.select(*keys, id_col).repartitionByRange(*keys, id_col).sortWithinPartitions(*keys, id_col).mapInArrow(chunks, f"{fields}, first long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashes, f"{fields}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of turn sequences, one row a node, from turns (conv_id, depth from 1, digest, n_chars) and (conv_id, n_turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, see
    README.  Without conversations there is no node.  A prefix is named by its depth and by four sums of 32-bit parts of its
    turns' hashes with their depths (128 bits), which can be added up in any order.  Identical conversations become one
    weighted sequence, which its smallest id stands for; from there on only these have rows.  Sequences that are proper
    prefixes of others are dropped by an anti-join, which leaves the leaves.  A node's own savings are put on the prefix
    of the conversation that names it, summed from the end of that sequence to its start, and then over the sequences that
    share a prefix: both sums of a subtree without walking it.
    """
    h = [F.xxhash64(F.lit(i), "depth", "digest") for i in (0, 1)]
    words = [F.shiftrightunsigned(h[0], 32), h[0].bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h[1], 32), h[1].bitwiseAND(0xFFFFFFFF)]
    turns = turns.select("conv_id", "depth", "n_chars", *(w.alias(n) for w, n in zip(words, ADDS)))
    totals = turns.groupBy("conv_id").agg(*(F.sum(w).alias(s) for w, s in zip(ADDS, SUMS)))
    zero = F.lit(0).cast("long")
    whole = written(conversations.join(totals, "conv_id", "left").select("conv_id", F.col("n_turns").cast("long").alias("depth"), *(F.coalesce(s, zero).alias(s) for s in SUMS)), "whole")
    node = ["depth", *SUMS]
    sequences = written(whole.groupBy(*node).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")
    ends = end_digests(whole, node)

    stands = sequences.select("conv_id", F.col("depth").alias("n_turns"), "weight")
    total = stands.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    own = lookup(turns, stands, ["conv_id"], F.col("n_turns"), total)
    walked = running_sums(own, ["conv_id"], ["depth"], {s: F.col(w) for s, w in zip(SUMS, ADDS)}, keep=written)
    parent = [(F.col(s) - F.col(w)).alias(p) for s, w, p in zip(SUMS, ADDS, PARENT)]
    columns = ["conv_id", "n_turns", "weight", *node, "n_chars", *PARENT]
    root = stands.select("conv_id", "n_turns", "weight", zero.alias("depth"), *(zero.alias(c) for c in SUMS), zero.alias("n_chars"), *(zero.alias(c) for c in PARENT))
    prefixes = written(walked.select("conv_id", "n_turns", "weight", *node, "n_chars", *parent).select(*columns).unionByName(root), "prefixes")

    shorter = prefixes.where("depth < n_turns").select(*node).distinct()
    leaves = sequences.select(*node).join(shorter, node, "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    grouped = prefixes.groupBy(*node).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n_chars").alias("n_chars"), *(F.min(p).alias(p) for p in PARENT))
    children = grouped.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(p).alias(s) for p, s in zip(PARENT, SUMS))).agg(F.count("*").alias("n_children"))
    nodes = written(grouped.join(children, node, "left").join(leaves, node, "left").withColumns({"n_children": F.coalesce("n_children", zero), "leaf": F.coalesce("leaf", zero)}), "nodes")

    values = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), "leaf")
    valued = prefixes.select("conv_id", *node).join(values, ["conv_id", "depth"], "left")
    valued = valued.withColumns({"saved": F.coalesce("saved", zero), "leaf": F.coalesce("leaf", zero)})
    below = running_sums(valued, ["conv_id"], [F.col("depth").desc()], {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaf")}, keep=written)
    below = below.groupBy(*node).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    above = nodes.select(F.col("depth").alias("up"), *(F.col(s).alias(p) for s, p in zip(SUMS, PARENT)), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    below_root = nodes.where("depth > 0").select(*node, (F.col("depth") - 1).alias("up"), *PARENT)
    n_nodes = nodes.count()
    parents = lookup(below_root, above, ["up", *PARENT], F.col("size"), n_nodes).select(*node, "parent_conv_id")
    out = nodes.join(below, node).join(ends, node, "left").join(parents, node, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
