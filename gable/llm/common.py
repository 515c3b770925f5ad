"""Helpers that the corpus operators share: shared folders, deterministic splits, skew-proof joins."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import remove_tables, shared_dir, write_table  # noqa: F401

#: Rows of an id table that may be broadcast (8 bytes each, so 8 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows in an Arrow batch, at most: whole texts, of any length, are sent to Python in these.
BATCH_ROWS = 2000
#: A join key with more than 1/HOT_SHARE of all rows is joined map-side. There can be at most HOT_SHARE such keys.
HOT_SHARE = 1000

#: Values that a class column may have, and bins in which the hashes of a class are counted.
MAX_CLASSES, SAMPLE_BINS = 1000, 1024

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already (PYTHONPATH or the working folder).

    Arrow batches of the session are bounded by BATCH_ROWS: a batch of long texts is held by the JVM and by Python at once.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if root in known or Path.cwd() == root or spark.sparkContext.applicationId in _shipped:
        return
    to = Path(tempfile.mkdtemp()) / "gable.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in (root / "gable").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(spark.sparkContext.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def may_learn(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn from. A row without an id has no remainder and is left out."""
    return F.coalesce(remainder(doc_id) != 1, F.lit(False))


def bounded_sample(df: DataFrame, by: str, limit: int, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """`by` and `key` of at most `limit` different keys of each class (and about `total` in all), the first in the order of a hash of the key.

    The same keys on every run, however often each is repeated; rows without a class or a key are left out. Sketches count the
    classes' keys; of the hashes that may be among the first, a histogram of SAMPLE_BINS a class gives the place to stop. So no
    task holds or ranks a class. A class column of over MAX_CLASSES values is an error.
    """
    from pyspark.sql import Window

    df = df.select(by, key).where(F.col(by).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(by).agg(F.approx_count_distinct(key, 0.02)).limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{by} has over {MAX_CLASSES} values; it is no class")
    if total is not None and counts:
        limit = min(limit, max(1, total // len(counts)))
    large = {k: n for k, n in counts.items() if n > 0.8 * limit}
    if not large:
        return df.distinct()
    # the bin of a hash: the first SAMPLE_BINS bins of a large class hold about twice the limit
    wide = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, min(1.0, 2.0 * limit / n) / SAMPLE_BINS)])
    at = F.floor(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 40)) / float(1 << 40) / F.try_element_at(wide, F.col(by)))
    own = df.withColumn("_bin", F.coalesce(at, F.lit(-1))).where(F.col("_bin") < SAMPLE_BINS).distinct()
    by_bin = own.where("_bin >= 0").groupBy(by, "_bin").count()
    to_here = F.sum("count").over(Window.partitionBy(by).orderBy("_bin"))  # SAMPLE_BINS rows a class
    last = by_bin.withColumn("to_here", to_here).where(F.col("to_here") <= limit).groupBy(by).agg(F.max("_bin").alias("_last"))
    return own.join(F.broadcast(last), by, "left").where((F.col("_bin") < 0) | (F.col("_bin") <= F.col("_last"))).select(by, key)


def join_counted(left: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left join groups on key, where groups has one row for each key and `size` is the number of left rows with it.

    Keys of over total/HOT_SHARE rows (at most HOT_SHARE of them, so their broadcast is bounded) are joined map-side; no
    task of the shuffled rest then gets more than total/HOT_SHARE rows of one key.
    """
    limit = max(1000, total // HOT_SHARE)
    hot = groups.where(F.col(size) > limit)
    rest = groups.where(F.col(size) <= limit)
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(hot_keys, key, "left_anti").join(rest, key))


def text_hash(text: str = "text") -> Column:
    """What tells rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _same_row(docs: DataFrame, rows: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(rows["_doc"]) & (text_hash() == rows["_text"])


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were. decided: doc_id, text_hash, kept of every row of docs.

    Rows are told by doc_id (null too) and text. Of rows that repeat both, one stays if one was kept and others weren't.
    """
    out = decided.where("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).distinct()
    few = out.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = F.broadcast(out) if few else out
    stays = decided.where("kept").select("doc_id", "text_hash")
    both = stays.join(out, stays["doc_id"].eqNullSafe(out["_doc"]) & (stays["text_hash"] == out["_text"]), "left_semi").distinct()
    kept = docs.join(out, _same_row(docs, out), "left_anti")
    if not both.limit(1).count():
        return kept
    both = both.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))
    once = docs.join(both, _same_row(docs, both), "left_semi").withColumn("_text", text_hash())
    return kept.unionByName(once.dropDuplicates(["doc_id", "_text"]).drop("_text"))


def slices(batch, size: int):
    """An Arrow batch in slices of rows, which bound what is held in Python at a time."""
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by a line feed, and where each text starts (one more entry: the end)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8), starts


# Character kinds: 0 space, 1 word (letters, digits, bytes over 127), 2 other signs. A token is a run of one kind.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


class Tokens:
    """Tokens of a byte array: where they start and end, their 64-bit hashes, and those of any other stretch.

    The hash is a polynomial in an odd base over lower-cased (A-Z) bytes, so prefix sums give that of every stretch.
    """

    def __init__(self, data: np.ndarray):
        kind = _KIND[data]
        edge = np.empty(len(data), bool)
        edge[:1] = True
        edge[1:] = kind[1:] != kind[:-1]
        starts = np.nonzero(edge)[0]
        ends = np.append(starts[1:], len(data))
        token = kind[starts] > 0
        self.starts, self.ends, self.word = starts[token], ends[token], kind[starts[token]] == 1
        self.sums, self.inverse = np.zeros(len(data) + 1, np.uint64), _powers(_INVERSE, len(data))
        with np.errstate(over="ignore"):
            np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.inverse[starts], seed)


def by_bytes(texts: list, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters, a longer text alone."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < size):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_only(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and further named columns) alone, so that other columns can't clash with an operator's own."""
    return df.select(F.col("doc_id").cast(T.LongType()).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
