"""Operator 10, exact deduplication by a minimal perfect hash over historical distinct digests.

A first generation of rows (the history) is grouped by SHA-256 digest and dealt to shards by digest. Each shard builds a
minimal perfect hash (bit arrays by level, as in BBHash): its slots hold the full digest, the locator of the winning row
and the group's size. Rows of the next generation, aggregated by digest before they are shuffled, are looked up: the slot's
digest is compared byte for byte, so that a non-member which falls on an occupied slot is recognised; members join the slot's
group, non-members form groups of their own.

Cases: null text counts as empty; a null doc_id never wins against a non-null one; of rows that repeat both doc_id and text one
is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, keep_rows, mix64, text_hash, text_only, write_table

#: Distinct digests for each shard, on average; a shard is built and probed in one task.
SHARD_KEYS = 100_000
#: Bits for each key that is still without a slot, in each level.
GAMMA = 2
INDEX = "shard int, slot long, digest binary, win_id long, win_uid long, size long"
GROUPS = "digest binary, keep_id long, keep_uid long, group_size long, member boolean"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _level(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(words[:, 1] ^ (words[:, 2] << np.uint64(level % 63)), level) % np.uint64(bits)).astype(np.int64)


def build_mph(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels (boolean arrays) and the slot of each key; slots are 0 to n-1. Keys must be distinct."""
    levels, slots, left, base = [], np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    while len(left):
        bits = max(8, GAMMA * len(left))
        at = _level(words[left], len(levels), bits)
        used = np.bincount(at, minlength=bits) == 1
        alone = used[at]
        rank = np.cumsum(used) - 1
        slots[left[alone]] = base + rank[at[alone]]
        base += int(used.sum())
        levels.append(used)
        left = left[~alone]
    return levels, slots


def probe_mph(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot that each key would have, -1 where no level has its bit. Whether it is a member the slot's digest tells."""
    slots, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, used in enumerate(levels):
        at = _level(words[left], k, len(used))
        hit = used[at]
        slots[left[hit]] = base + (np.cumsum(used) - 1)[at[hit]]
        base += int(used.sum())
        left = left[~hit]
    return slots


def _pack(levels: list[np.ndarray]) -> bytes:
    head = np.array([len(levels), *map(len, levels)], np.int64).tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in levels)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), []
    for s in map(int, sizes):
        k = (s + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, k, at), count=s).astype(bool))
        at += k
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    levels, slots = build_mph(_words(list(pdf["digest"])))
    own = pdf.assign(slot=slots)[["shard", "slot", "digest", "win_id", "win_uid", "size"]]
    head = pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "slot": [-1], "digest": [_pack(levels)], "win_id": [None], "win_uid": [None], "size": [0]})
    return pd.concat([head.astype({"win_id": "Int64", "win_uid": "Int64"}), own.astype({"win_id": "Int64", "win_uid": "Int64"})])


def _probe(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    cols = ["digest", "keep_id", "keep_uid", "group_size", "member"]
    table = index[index["slot"] >= 0].sort_values("slot")
    digests = table["digest"].to_numpy(object)
    best = [(i is not pd.NA and i == i and i is not None, i, u) for i, u in zip(table["win_id"].astype(object), table["win_uid"].astype(object))]
    sizes = table["size"].to_numpy(np.int64).copy()
    alone = []
    if len(new):
        levels = _unpack(index.loc[index["slot"] == -1, "digest"].iloc[0]) if len(index) else []
        slots = probe_mph(levels, _words(list(new["digest"])))
        for d, s, i, u, n in zip(new["digest"], slots, new["win_id"].astype(object), new["win_uid"].astype(object), new["size"]):
            known = i is not None and i is not pd.NA and i == i
            if s >= 0 and bytes(digests[s]) == bytes(d):  # the byte check
                sizes[s] += n
                if (known, i if known else 0, u) > (best[s][0], best[s][1] if best[s][0] else 0, best[s][2]):
                    best[s] = (known, i, u)
            else:
                alone.append((d, i if known else None, u, n, False))
    rows = [(d, i if k else None, u, n, True) for d, (k, i, u), n in zip(digests, best, sizes)]
    return pd.DataFrame(rows + alone, columns=cols).astype({"keep_id": "Int64", "keep_uid": "Int64", "group_size": "int64", "member": bool})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, uid (of the row), digest and text_hash, written once; the text goes no further."""
    rows = text_only(docs).select("doc_id", text_hash().alias("text_hash"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    return write_table(rows.withColumn("uid", F.monotonically_increasing_id()), "digests")


def _aggregate(rows: DataFrame, shards: int) -> DataFrame:
    # struct order puts null first, so a null id wins only alone
    best = F.max(F.struct("doc_id", "uid"))
    return (
        rows.groupBy("digest").agg(best.alias("w"), F.count("*").alias("size"))
        .select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", F.col("w.doc_id").alias("win_id"), F.col("w.uid").alias("win_uid"), "size")
    )


def groups(rows: DataFrame, history: Column, total: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """digest, keep_id, keep_uid, group_size, member (of the history): one row for each distinct digest."""
    shards = max(1, -(-total // shard_keys))
    old = _aggregate(rows.where(history), shards)
    new = _aggregate(rows.where(~history), shards)
    index = write_table(old.groupBy("shard").applyInPandas(_build, INDEX), "mph")
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_probe, GROUPS)


def generation() -> Column:
    """The history of a table that has none of its own: half of its rows, by a hash of the row's id."""
    return F.pmod(F.xxhash64("uid"), F.lit(2)) == 0


def exact_dedup(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, member (its digest was in the history), text_hash."""
    rows = digests(docs)
    total = rows.count()
    found = write_table(groups(rows, generation() if history is None else history, total), "groups")
    out = join_counted(rows, found, "digest", "group_size", total)
    return out.select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member", "text_hash",
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs without exact copies, all columns as they were."""
    return keep_rows(docs, write_table(exact_dedup(docs).select("doc_id", "text_hash", "kept"), "exact"))
