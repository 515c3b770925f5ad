"""Operator 3, sequence packing by non-negative least squares over length combinations.

Tokenising and counting is one pass: every task tokenises its documents (ids by the byte-level BPE file, then id 0), cuts whole
windows of 1024 ids off the front and writes the rest's length, its rank among equal rests of the task, and all ids (two bytes each)
to the shared folder. The histogram of rests (at most 1024 lengths) is solved on the driver: combinations of up to three lengths
that fill the window exactly are the columns of a non-negative least-squares problem, its solution the repeat counts, rounded
so that no length is overdrawn. A rest's global rank in its length, from counts by task, tells which combination it falls in.
What rounding leaves is packed greedily: laid end to end and cut at window ends; the last, partial window is split into
powers of two, which need no padding. A second pass over the written ids cuts the pieces and their checksums.

Cases: null and empty texts are one id (0); an added token of the file (`<|endoftext|>`) in a text is its one id; rows with the same doc_id are packed each on their own; very long texts give many whole windows; an empty
table gives an empty result. sequence_id is unique and offsets in a sequence are gapless from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import slices, text_only, write_table

WINDOW = 1024
#: Lengths in a combination, at most.
DEPTH = 3
#: Tasks whose offsets (up to WINDOW rows each) may be broadcast; with more, the ids are joined with them by a shuffle.
BROADCAST_TASKS = 500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(window: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        part, seen, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            for piece in slices(batch, 1000):
                ids = [x.astype("<u2").tobytes() + b"\0\0" for x in bpe.encode_added(piece.column("text").to_pylist())]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                rest, rank, before = n % window, np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                for i, r in enumerate(rest):
                    rank[i], before[i] = seen[r], full
                    seen[r] += 1
                    full += n[i] // window
                cols = [piece.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(n), pa.array(rest), pa.array(rank), pa.array(before), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "n", "rest", "rank", "full_before", "ids"])

    return run


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a >= b >= c, 0 where shorter) of the combinations of at most DEPTH present lengths that sum to the window."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    a = np.nonzero(present)[0]
    a = a[a > 0]
    two = np.array([(x, window - x, 0) for x in a if 2 * x >= window and x < window and present[window - x]], np.int64).reshape(-1, 3)
    b, c = np.meshgrid(a, a, indexing="ij")
    keep = c <= b
    b, c = b[keep], c[keep]
    x = window - b - c
    keep = (x >= b) & (x <= window)
    b, c, x = b[keep], c[keep], x[keep]
    keep = present[x]
    three = np.stack([x[keep], b[keep], c[keep]], 1)
    return np.concatenate([two, three]).astype(np.int64)


def solve(histogram: np.ndarray, window: int = WINDOW, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts with A x <= histogram.

    min |A x - h| over x >= 0 by accelerated projected gradient steps (A has at most DEPTH entries a column), then rounding and,
    in order of the counts, clipping to what is left of each length.
    """
    combos = combinations(np.nonzero(histogram)[0], window)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    h = histogram.astype(float)
    scale = 1 / np.sqrt(np.maximum(h, 1))  # rare lengths count as much as common ones
    weight = np.where(combos > 0, scale[combos], 0.0)

    def ax(x):
        return sum(np.bincount(combos[:, k], weights=weight[:, k] * x, minlength=window) for k in range(DEPTH))

    target = h * scale
    target[0] = 0

    def gradient(x):
        left = ax(x) - target
        left[0] = 0
        return (weight * left[combos]).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(12):  # power iteration for the step size
        g = gradient(v) - gradient(np.zeros(len(combos)))
        bound = np.sqrt(g @ g) / np.sqrt(v @ v)
        v = g / (np.sqrt(g @ g) or 1)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - gradient(y) / (1.05 * bound))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(combos), np.int64)
    for wanted in (np.floor(x), np.ceil(x) - np.floor(x)):
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1e-3:
                break
            uses = combos[i][combos[i] > 0]
            size, need = np.unique(uses, return_counts=True)
            m = int(min(wanted[i], (left[size] // need).min()))
            if m > 0:
                counts[i] += m
                left[size] -= m * need
    used = counts > 0
    return combos[used], counts[used]


class Plan:
    """Where the rest of a given length and global rank goes. Its size depends on the window alone, not on the corpus."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.combos, self.counts = window, *solve(histogram, window)
        first = np.cumsum(self.counts) - self.counts if len(self.counts) else np.zeros(0, np.int64)
        self.sequences = int(self.counts.sum())
        self.assigned = np.zeros(window, np.int64)
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        for combo, n, base in zip(self.combos, self.counts, first):
            at = 0
            for length in combo[combo > 0]:
                start = int(self.assigned[length])
                spans.setdefault(int(length), []).append((start, int(base), at))
                self.assigned[length] += n
                at += int(length)
        self.spans = {k: tuple(np.array(x) for x in zip(*v)) for k, v in spans.items()}

    def place(self, length: int, rank: int) -> tuple[int, int] | None:
        """Sequence and offset, or None for a rest that the combinations leave over."""
        if rank >= self.assigned[length]:
            return None
        starts, bases, offsets = self.spans[length]
        k = int(np.searchsorted(starts, rank, "right")) - 1
        return int(bases[k] + rank - starts[k]), int(offsets[k])


def _cut(plan: Plan, window: int, full_at: int, stream_at: int, tail_at: int, stream_tokens: int):
    """Pieces of each document. Sequences are numbered: combinations, then whole windows, then the stream of left-over rests."""
    whole = stream_tokens // window * window
    tail, powers = stream_tokens - whole, []
    at = whole
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            powers.append((at, at + (1 << bit)))
            at += 1 << bit

    def windows(begin: int, end: int):
        """(sequence, offset, length) of the stream's ids from begin to end."""
        while begin < end:
            if begin < whole:
                k = begin // window
                stop = min(end, (k + 1) * window)
                yield stream_at + k, begin - k * window, stop - begin
            else:
                k = next(i for i, (a, b) in enumerate(powers) if a <= begin < b)
                stop = min(end, powers[k][1])
                yield tail_at + k, begin - powers[k][0], stop - begin
            begin = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "rest", "rank", "full_before", "rank_base", "full_base", "stream_base", "stream_rank", "ids")]
            for doc, n, rest, rank, before, rank_base, full_base, stream_base, stream_rank, ids in zip(*columns):
                pieces = [(full_at + full_base + before + k, 0, window) for k in range(n // window)]
                if rest:
                    place = plan.place(rest, rank_base + rank)
                    if place:
                        pieces.append((*place, rest))
                    else:
                        begin = stream_base + (rank_base + rank - stream_rank) * rest
                        pieces += windows(begin, begin + rest)
                at, view = 0, memoryview(ids)
                for sequence, offset, length in pieces:
                    for column, value in zip(out, (doc, at, length, _crc(view[2 * at : 2 * (at + length)]), n, sequence, offset)):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def _crc(two_byte_ids: memoryview) -> int:
    return zlib.crc32(np.frombuffer(two_byte_ids, "<u2").astype("<u4").tobytes())


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = write_table(text_only(docs).mapInArrow(_tokenise(window, vocabulary), "doc_id long, part long, n long, rest long, rank long, full_before long, ids binary"), "tokens")
    by_part = tokens.groupBy("part", "rest").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    by_part = write_table(by_part, "rests")  # at most `window` rows for each task
    histogram = np.zeros(window, np.int64)
    for r in by_part.groupBy("rest").agg(F.sum("docs").alias("docs")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["docs"]
    plan = Plan(histogram, window)
    assigned = F.array(*[F.lit(int(x)) for x in plan.assigned])
    ranked = by_part.withColumn("rank_base", F.sum("docs").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.fillna(0, ["rank_base"]).withColumn("assigned", F.element_at(assigned, (F.col("rest") + 1).cast("int")))
    # ranks from stream_rank on are of this task and left over
    ranked = ranked.withColumn("stream_rank", F.greatest("rank_base", "assigned"))
    ranked = ranked.withColumn("left", F.greatest(F.lit(0), F.col("rank_base") + F.col("docs") - F.col("stream_rank")) * F.col("rest"))
    parts = ranked.groupBy("part").agg(F.sum("left").alias("part_left"), F.sum("full").alias("part_full"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = parts.select("part", F.coalesce(F.sum("part_left").over(before), F.lit(0)).alias("left_base"), F.coalesce(F.sum("part_full").over(before), F.lit(0)).alias("full_base"))
    inside = Window.partitionBy("part").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("inner", F.coalesce(F.sum("left").over(inside), F.lit(0))).join(parts, "part")
    bases = write_table(ranked.select("part", "rest", "rank_base", "full_base", "left", (F.col("left_base") + F.col("inner")).alias("stream_base"), "stream_rank"), "bases")
    sums = bases.agg(F.coalesce(F.sum("left"), F.lit(0)), F.countDistinct("part")).first()
    stream = int(sums[0])
    full = by_part.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    small = F.broadcast(bases.drop("left")) if sums[1] <= BROADCAST_TASKS else bases.drop("left")
    full_at = plan.sequences
    stream_at = full_at + int(full)
    return tokens.join(small, ["part", "rest"]).mapInArrow(_cut(plan, window, full_at, stream_at, stream_at + stream // window, stream), PIECES)
