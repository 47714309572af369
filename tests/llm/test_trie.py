"""The prefix trie against a plain one, with members and subtrees listed."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from casewright.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_turns int"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Short tables too are dealt in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    talks = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (first(r[1]), r[2] or "", r[3] or "")):
        talks.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(talks.get(c - c % 100, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for path, got in members.items():
        below = [p for p in members if p[: len(path)] == path]
        has = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        text = ",".join(map(str, sorted(ends.get(path, []))))
        out[min(got), len(path)] = (
            min(members[path[:-1]]) if path else None, len(got), has(path), sum(not has(p) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def told(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def conversations(rnd, n):
    rows = []
    for c in rnd.sample(range(350), n):
        length = rnd.choice([1, 1, 2, 3, 5, 9])
        for t in range(length):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "é", "日本", "", None])))
    return rows


def test_trie_equals_a_plain_one(spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        rows = conversations(rnd, 120)
        rows += rnd.sample(rows, 10) + [(None, 0, "user", "lost"), (400, 0, "user", "a"), (7, 0, "user", "only"), (107, 0, "user", "only")]
        assert told(pt.prefix_trie(*pt.rebuilt(table(spark, rows)))) == brute(rows)


def test_trie_with_hot_keys_and_short_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 3)
    plain = pt.lookup
    monkeypatch.setattr(pt, "lookup", lambda rows, t, keys, size, total: plain(rows, t, keys, size + 1000, 9 * pt.HOT_KEYS))  # keys with ten rows are hot
    rows = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(3)]  # identical ones
    rows += [(300, t, "user", f"long {t % 2}") for t in range(700)] + [(c, 0, "user", f"other {c}") for c in range(200, 240)]
    assert told(pt.prefix_trie(*pt.rebuilt(table(spark, rows)))) == brute(rows)


def test_no_conversations(spark):
    assert pt.prefix_trie(*pt.rebuilt(table(spark, []))).collect() == []
    assert pt.prefix_trie(*pt.rebuilt(table(spark, [(None, 1, "user", "x")]))).collect() == []


def test_digests_of_long_lists(spark):
    rows = spark.range(20_000).select(F.lit(2).cast("long").alias("depth"), (F.col("id") % 2).alias("s0"), F.col("id").alias("conv_id")).repartition(5)
    got = {r.s0: r.ends_sha256 for r in pt.end_digests(rows, ["depth", "s0"]).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 20_000, 2))).encode()).hexdigest() for k in (0, 1)}
