"""Operator 9, chat formatting of reply trees.

Nodes have a parent in the same conversation. Root-to-leaf paths are enumerated by iterative self-joins on the parent link with
doubling: after k joins every node that has a 2^k-th ancestor knows it and the sum of scores on the way, so a path of n turns
takes about log2(n) joins, and each table holds the nodes that are deep enough, one row each. Leaves are ranked in their conversation by the mean score of their path; the
chosen leaves' paths are enumerated by the same jumps from the largest down, and each path is formatted as one conversation.

The template is `<|im_start|>role LF text<|im_end|> LF` for each turn. Inside roles and texts a backslash is doubled and `<|`
becomes `<\\|`, so no control string can stand in a text, and reading back undoes both; a line feed in a role becomes `\\n`.

A formatted conversation is a table of turns in order, one row each, so that none is held whole; reading back goes through the rows of
a conversation in order and keeps running digests alone.

Cases: null text and null role are empty; turns of equal number in one conversation stand in the order of role, then text; a null
conv_id is a conversation of its own, a null turn comes first; an empty table gives only what the query itself adds. A conversation
may be of any length: its turns are put in order by a range partitioning that cuts it, its offsets are sums over chunks of turns; only the
digests of one conversation are one task's (they are sequential), in constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Turns whose offsets are summed in one group.
CHUNK = 4096
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def linear_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, node, role, text) and links (conv_id, node, parent, score) of conversations without replies of their own.

    Each turn answers the one before it; every score is 0. Node numbers rise in the order of all turns, which a range partitioning by
    conversation, turn, role, text (and row) gives: a conversation of many turns lies in several partitions.
    """
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).withColumn("row", F.monotonically_increasing_id())
    order = ("conv_id", "turn", "role", "text", "row")
    nodes = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("node"), "role", "text")
    nodes = write_table(nodes, "turns")
    own = nodes.select("node", "conv_id")
    # the last node of the partition before, for the first of each
    ends = own.groupBy(F.shiftright("node", 33).alias("part")).agg(F.min("node").alias("node"), F.max("node").alias("last"))
    ends = ends.select("node", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row for each partition
    before = own.join(F.broadcast(ends), "node", "left").select("conv_id", "node", F.coalesce("before", F.col("node") - 1).alias("before"))
    last = own.select(F.col("node").alias("before"), F.col("conv_id").alias("conv_before"))
    parent = F.when(F.col("conv_id").eqNullSafe(F.col("conv_before")), F.col("before"))
    # a node without one before it has no row on the right: the first of all
    there = last.withColumn("there", F.lit(True))
    links = before.join(there, "before", "left").select("conv_id", "node", F.when(F.col("there"), parent).alias("parent"), F.lit(0.0).alias("score"))
    return nodes, links


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch (its rank), node, depth (from the root, 0) of the best root-to-leaf paths of each conversation.

    nodes: conv_id, node (unique), parent (null at a root; a parent that isn't there counts as null), score. Ranks go by the mean
    score of the path, highest first, ties to the smaller leaf.
    """
    links = nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = links.join(known, "parent", "left").select("conv_id", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    links = write_table(links, "known-links")
    # level k: nodes that have a 2^k-th ancestor, that ancestor, and the sum of scores on the way to it
    jumps, step = [], links.where("parent is not null").select("node", F.col("parent").alias("anc"), "score")
    while step.limit(1).count():
        jumps.append(step)
        if len(jumps) > 62:
            raise ValueError("parents form a cycle")
        far = step.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("score").alias("score2"))
        step = write_table(step.join(far, "anc").select("node", F.col("anc2").alias("anc"), (F.col("score") + F.col("score2")).alias("score")), "jumps")
    leaves = links.join(links.where("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    # the path of each leaf: the largest jumps first, until a root is met
    walk = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("turns"))
    for k in reversed(range(len(jumps))):
        joined = walk.join(jumps[k], "node", "left")
        there = F.col("anc").isNotNull()
        walk = joined.select(
            "conv_id", "leaf", F.coalesce("anc", "node").alias("node"), (F.col("total") + F.coalesce("score", F.lit(0.0))).alias("total"),
            (F.col("turns") + F.when(there, 1 << k).otherwise(0)).alias("turns"),
        )
    walk = walk.join(links.select("node", "score"), "node")
    best = Window.partitionBy("conv_id").orderBy(F.desc((F.col("total") + F.col("score")) / F.col("turns")), "leaf")
    path = walk.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    path = write_table(path.select("conv_id", "branch", F.col("leaf").alias("node"), (F.col("turns") - 1).alias("depth")), "leaves")
    for k in reversed(range(len(jumps))):
        up = jumps[k].select("node", "anc")
        path = path.unionByName(path.join(up, "node").select("conv_id", "branch", F.col("anc").alias("node"), (F.col("depth") - (1 << k)).alias("depth")))
        path = write_table(path, "path")
    return path


def format_turns(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """conv_id, branch, depth, piece, begin and stop: the formatted turns of each path. A conversation is its pieces in order of depth.

    begin, stop: where in the piece (in code points) the text is that is learned; null where none is.
    """
    turns = path.join(nodes.select("node", "role", "text"), "node")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.col("text"))
    begin = F.when(F.coalesce("role", F.lit("")) == LEARNED, F.length(head).cast("long"))
    return turns.select("conv_id", "branch", "depth", F.concat(head, body, F.lit(END + "\n")).alias("piece"), begin.alias("begin"), (begin + F.length(body)).alias("stop"))


def with_offsets(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Formatted turns with `at`, where each piece begins in its conversation. Sums go by chunks of turns, then within them."""
    of = F.col("depth") - F.pmod(F.col("depth"), F.lit(chunk))
    own = turns.withColumn("chunk", of)
    sums = own.groupBy("conv_id", "branch", "chunk").agg(F.sum(F.length("piece")).alias("chars"))
    before = Window.partitionBy("conv_id", "branch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("branch").alias("_branch"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("_base"))
    joined = own.join(sums, own["conv_id"].eqNullSafe(sums["_conv"]) & (own["branch"] == sums["_branch"]) & (own["chunk"] == sums["_chunk"]))
    inside = Window.partitionBy("conv_id", "branch", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_base") + F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0))
    return joined.withColumn("at", at).drop("_conv", "_branch", "_chunk", "_base", "chunk")


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, text) and the texts under the loss mask, from formatted turns."""
    turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
    return turns, [unescape(formatted[a:b]) for a, b in spans]


class _Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns = self.learned = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, begin: int | None, stop: int | None) -> None:
        turns, learned = read_back(piece, [(begin, stop)] if begin is not None else [])
        self.turns += len(turns)
        self.chars += len(piece)
        for role, text in turns:
            self.all.update(f"{role}\n{text}\n".encode())
        for text in learned:
            self.learned += len(text)
            self.loss.update(text.encode())

    def row(self, key: tuple) -> tuple:
        return (*key, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars)


_DIGESTS = [("conv_id", pa.int64()), ("branch", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and branch, in order of depth; a conversation may span batches."""
    key, digest = None, _Digest()

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _DIGESTS)], [n for n, _ in _DIGESTS])

    for batch in batches:
        done = []
        for conv, branch, piece, begin, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "branch", "piece", "begin", "stop"))):
            if (conv, branch) != key:
                if key is not None:
                    done.append(digest.row(key))
                key, digest = (conv, branch), _Digest()
            digest.add(piece, begin, stop)
        if done:
            yield out(done)
    if key is not None:
        yield out([digest.row(key)])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, branch, and what can be read back from each conversation's formatted turns."""
    rows = turns.select("conv_id", F.col("branch").cast("int").alias("branch"), "depth", "piece", "begin", "stop")
    rows = rows.repartition("conv_id", "branch").sortWithinPartitions("conv_id", "branch", "depth")
    return rows.mapInArrow(_digests, "conv_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Every conversation of a table of turns (conv_id, turn, role, text), formatted turn by turn."""
    nodes, links = linear_tree(turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
    return format_turns(nodes, chosen_paths(write_table(links, "links")))
