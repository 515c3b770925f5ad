"""Operator 12, vector code compression by ball k-means.

Vectors of integers are cut into equal parts; each part position has a codebook, whose entries are the centres of balls of parts. The first round
compares every part with every entry. After that a ball is known by its entry's members: the distance of its farthest member bounds its radius,
and the shift of its entry is added when the entry has moved. Only entries nearer than twice the radius are its neighbours. A member nearer to its
entry than half the way to the nearest neighbour is in the stable core and keeps its entry without further work; one outside is in a ring between half the
distances to its neighbours in order, and is compared with the neighbours up to its ring, which are all that can be as near. All of it is exact in
integers, and ties go to the lower index, so the codes are those of comparing every part with every entry.

Each round is a map over the rows, which are written with their codes, and an aggregation of counts, component sums and radii by part and entry, summed in
the map tasks first: what reaches the driver and goes to the tasks is the codebooks (entries x components), however many rows there are.

Cases: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another length than the most common
one; rows that repeat a vec_id are all coded, and the first entries are then the smallest in order of vec_id and vector; a row without vec_id is coded, but
is no first entry; with fewer rows than entries the codebooks are shorter; an empty table gives an empty result. A length that the parts don't divide, and components
so large that an error needs over 64 bits, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, ship, slices, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows worked on at a time.
ROWS = 4096
#: Above every squared distance.
FAR = np.iinfo(np.int64).max


@dataclass
class Balls:
    """Codebooks (parts x entries x width) and, once parts are assigned, each entry's neighbours in order (parts x entries x most) with the squared distance to them, FAR where there is none."""

    entries: np.ndarray
    near: np.ndarray | None = None
    apart: np.ndarray | None = None

    def surround(self, radius: np.ndarray) -> Balls:
        """Find the neighbours. radius (parts x entries): not less than the distance of any member; -1 for an empty ball."""
        between = ((self.entries[:, :, None] - self.entries[:, None]) ** 2).sum(3)
        reach = [[min(4 * r * r, FAR - 1) if r >= 0 else -1 for r in book] for book in radius.tolist()]
        between = np.where(between <= np.array(reach, np.int64)[:, :, None], between, FAR)
        between[:, np.arange(between.shape[1]), np.arange(between.shape[1])] = FAR
        self.near = np.argsort(between, axis=2, kind="stable")
        self.apart = np.take_along_axis(between, self.near, 2)
        return self

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part of x (rows x parts x width), all entries compared, and the squared distances."""
        code = np.zeros(x.shape[:2], np.int64)
        best = np.full(x.shape[:2], FAR)
        most = max(abs(x).max(initial=0), abs(self.entries).max(initial=0))
        exact = 4 * x.shape[2] * int(most) ** 2 < 1 << 52  # doubles then hold every sum of products
        for m, book in enumerate(self.entries):
            if exact:
                own, entries = x[:, m].astype(np.float64), book.astype(np.float64)
                d = (own * own).sum(1)[:, None] - 2 * own @ entries.T + (entries * entries).sum(1)
                code[:, m] = d.argmin(1)
                best[:, m] = d[np.arange(len(d)), code[:, m]]
                continue
            for i, entry in enumerate(book):
                d = ((x[:, m] - entry) ** 2).sum(1)
                nearer = d < best[:, m]
                code[nearer, m] = i
                best[nearer, m] = d[nearer]
        return code, best

    def again(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, from the entries of the round before."""
        code, best = code.copy(), np.empty(code.shape, np.int64)
        for m, book in enumerate(self.entries):
            own, part = code[:, m].copy(), np.ascontiguousarray(x[:, m])
            least = ((part - book[own]) ** 2).sum(1)
            ring = (self.apart[m][own] <= 4 * least[:, None]).sum(1)  # neighbours to compare, in order; none in the core
            to = own.copy()
            for k in range(int(ring.max(initial=0))):
                at = np.nonzero(ring > k)[0]
                i = self.near[m][own[at], k]
                d = ((part[at] - book[i]) ** 2).sum(1)
                nearer = (d < least[at]) | ((d == least[at]) & (i < to[at]))
                to[at[nearer]] = i[nearer]
                least[at[nearer]] = d[nearer]
            code[:, m], best[:, m] = to, least
        return code, best


def _rows(batch, parts: int) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8")
    return x.reshape(batch.num_rows, parts, -1)


def _assign(rows: DataFrame, balls: Balls) -> DataFrame:
    """Rows with the code of every part and the summed squared distance to the entries."""
    parts, known = len(balls.entries), "code" in rows.columns
    carried = [c for c in rows.columns if c not in ("code", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ROWS):
                x = _rows(batch, parts)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64) if known else None
                code, best = balls.again(x, code) if known else balls.first(x)
                cols = [batch.column(c) for c in carried] + [pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(best.sum(1))]
                yield pa.RecordBatch.from_arrays(cols, [*carried, "code", "error"])

    return rows.mapInArrow(run, f"{', '.join(f'{c} {dict(rows.dtypes)[c]}' for c in carried)}, code binary, error long")


def _members(rows: DataFrame, balls: Balls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, component sums and largest squared distance of the members of each ball."""
    parts, entries, width = balls.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, np.int64)
        sums, far = np.zeros((parts * entries, width), np.int64), np.full(parts * entries, -1, np.int64)
        for whole in batches:
            for batch in slices(whole, ROWS):
                x = _rows(batch, parts)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
                cell = (np.arange(parts) * entries + code).ravel()
                flat = x.reshape(-1, width)
                n += np.bincount(cell, minlength=len(n))
                np.add.at(sums, cell, flat)
                np.maximum.at(far, cell, ((flat - balls.entries.reshape(-1, width)[cell]) ** 2).sum(1))
        used = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(far[used]), *(pa.array(s[used]) for s in sums.T)], names)

    names = ["cell", "n", "far", *(f"s{i}" for i in range(width))]
    found = rows.select("x", "code").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    n, sums, far = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64), np.full(parts * entries, -1, np.int64)
    for r in found.groupBy("cell").agg(F.sum("n"), F.max("far"), *(F.sum(c) for c in names[3:])).collect():  # a row for each entry
        n[r[0]], far[r[0]], sums[r[0]] = r[1], r[2], r[3:]
    return n.reshape(parts, entries), sums.reshape(parts, entries, width), far.reshape(parts, entries)


def _move(balls: Balls, n: np.ndarray, sums: np.ndarray, far: np.ndarray) -> Balls:
    """Entries at their members' means, rounded down, and what their balls reach from there at most."""
    moved = np.where(n[..., None] > 0, sums // np.maximum(n, 1)[..., None], balls.entries)
    shift = ((moved - balls.entries) ** 2).sum(2)
    reach = [isqrt(int(f)) + 1 + (isqrt(int(s)) + 1 if s else 0) if f >= 0 else -1 for f, s in zip(far.ravel(), shift.ravel())]
    return Balls(moved).surround(np.array(reach, object).reshape(far.shape))


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (array of long) of the rows that take part: every component times scale, rounded down."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("_v"))
    own = own.where(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = own.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    own = own.where(F.size("_v") == (common["n"] if common else 0))
    return own.select("vec_id", "label", F.transform("_v", lambda x: F.floor(x * scale)).alias("v"))


def _pack(rows: DataFrame) -> DataFrame:
    """vec_id, label and x, the components as little-endian 64-bit integers end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ROWS):
                if batch.num_rows:
                    v = batch.column("v")
                    x = v.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "x"])

    return rows.mapInArrow(run, "vec_id long, label string, x binary")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code: a byte for each part, error: summed squared distance to the entries) and the codebooks (parts x entries x width; None without rows)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    ship(rows.sparkSession)
    own = integers(rows, scale)
    most = own.agg(F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"), F.count(F.lit(1)).alias("n")).first()
    start = own.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect() if most["n"] else []
    if not start:
        return _pack(own).select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), None
    dim = most["size"]
    if dim % parts or not dim:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    if 4 * dim * (most["most"] + 1) ** 2 >= 1 << 61 or most["n"] * (most["most"] + 1) >= 1 << 62:
        raise ValueError("components too large for errors of 64 bits")
    balls = Balls(np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).swapaxes(0, 1))
    table = write_table(_assign(_pack(own), balls), "balls")
    for k in range(rounds):
        balls = _move(balls, *_members(table, balls))
        assigned = _assign(table, balls)
        table = write_table(assigned if k < rounds - 1 else assigned.drop("x"), "balls")
    return table.select("vec_id", "label", "code", "error"), balls.entries


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over all rows of the same label, those without one together."""
    key = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("+"), "label"))
    own = coded.withColumn("_key", key)
    sums = own.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_counted(own, sums, "_key", "_n", coded.count()).drop("_key", "_n")


def books_sha256(books: np.ndarray | None) -> str:
    """Digest of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()
