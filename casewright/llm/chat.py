"""Chat formatting (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.common import written

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]")
ESCAPE = "\\"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}


def escape(text: str) -> str:
    """Double each backslash, then put one after the first character of each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROL:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    return (ESCAPE).join(part.replace(ESCAPE, "") for part in text.split(ESCAPE * 2)) if ESCAPE in text else text


def format_turn(role: str, text: str) -> str:
    """Roles other than user, assistant and system keep their name, which stands escaped before a line feed."""
    if role in MARKS:
        before, after = MARKS[role]
        return before + escape(text) + after
    return "[TURN]" + escape(role).replace("\n", ESCAPE + "n") + "\n" + escape(text) + "[/TURN]"


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation.  No control string occurs in escaped text."""
    at, ends = 0, {before: (role, after) for role, (before, after) in MARKS.items()}
    while at < len(formatted):
        if formatted.startswith("[TURN]", at):
            line, end = formatted.index("\n", at), formatted.index("[/TURN]", at)
            role = ESCAPE.join(p.replace(ESCAPE + "n", "\n").replace(ESCAPE, "") for p in formatted[at + 6 : line].split(ESCAPE * 2))
            yield role, unescape(formatted[line + 1 : end])
            at = end + 7
            continue
        before = next(b for b in ends if formatted.startswith(b, at))
        role, after = ends[before]
        end = formatted.index(after, at + len(before))
        yield role, unescape(formatted[at + len(before) : end])
        at = end + len(after)


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node): the nodes of the best ``branches`` root-to-leaf paths of each reply tree.

    ``nodes``: tree, node, parent (null at a root), score.  A branch's score is the sum along its path; ties go to the
    smaller leaf.  Self-joins double the reach of each node's link and of its sum every time, so that a path of n turns
    takes about log2(n) joins; then the chosen leaves walk up by the same links, longest first.  Nodes whose parent is
    missing count as roots; nodes on a cycle have no root and so no path.
    """
    ids = nodes.select(F.col("tree").alias("tree"), F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = nodes.join(ids, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    state, jumps = written(links, "links"), []
    while len(jumps) < 41 and not (here := state.where("up IS NOT NULL")).isEmpty():  # only a cycle has paths of over 2**40 nodes
        jumps.append(here)
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"))
        longer = here.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"))
        state = written(longer.unionByName(state.where("up IS NULL")), "links")  # what has its root takes part no more
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = state.where("up IS NULL").join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    walk = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank", "node")
    for jump in reversed(jumps):  # the walk is read twice in each step, so it is written, or the plan would double too
        walk = written(walk, "walk")
        walk = walk.unionByName(walk.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node")))
    return walk


def format_conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted and the loss spans of each chosen branch.

    ``nodes``: tree, node, parent, score, ord (the place among the tree's nodes), role, text.  Null text is empty, null
    role is "".  ``loss``: (start, length) of each assistant text as it stands, escaped, in ``formatted``.  A branch is
    one row and so is built in one task, as its result must be.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, spans = [], []
            for turns in b.column(3).to_pylist():
                parts, loss, at = [], [], 0
                for t in turns:
                    part = format_turn(t["role"], t["text"])
                    if t["role"] == "assistant":
                        before, after = MARKS["assistant"]
                        loss.append({"start": at + len(before), "length": len(part) - len(before) - len(after)})
                    parts.append(part)
                    at += len(part)
                out.append("".join(parts))
                spans.append(loss)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], ["tree", "leaf", "rank", "formatted", "loss"])

    text = nodes.select("tree", "node", "ord", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = reply_paths(nodes, branches).join(text, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("ord", "role", "text"))).alias("turns"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return turns.mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['node']}, rank int, formatted string, loss array<struct<start:long,length:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from ``formatted`` and ``loss`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n, turns = 0, hashlib.sha256()
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learnt = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                rows.append((n, turns.hexdigest(), len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss").mapInArrow(run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Reply trees without branches from rows (conv_id, turn, role, text): each row answers the one before it.

    Rows of one conversation and one turn stand in order of role, then text (nulls first); repeated rows stay.  Rows
    with a null conv_id form one conversation, with id null in the result of :func:`chat_digests`.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.struct("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), F.col("node").alias("ord"), "role", "text")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and digests of every conversation, after formatting it and reading it back."""
    return read_back(format_conversations(written(linear_nodes(conversations), "nodes"))).select(F.col("tree.conv_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
