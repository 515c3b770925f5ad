"""Operator 2, approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids (as many as the root of the number of vectors) and codebooks are fitted by k-means on a bounded sample (SAMPLE vectors, BYTES); every
vector is then assigned, its residual quantised. A query visits the lists whose centroids have the largest inner products with it: as many
as sampled queries need to find RECALL of their true neighbours in the sample. So clustered vectors cost few lists a query, vectors
without structure many. Lists are laid end to end, near ones beside one another, and cut into shards of bounded size in vectors and bytes (a large list
spans several); a vector goes to one shard, a query to the shards that hold a list it visits, and nowhere else, with the numbers of
those lists. A shard that very many queries visit is copied for every QUERIES of them. In a shard's task the asymmetric distance table of a query (inner products with the codewords)
scores the codes of the lists it visits. A code's score is wrong by at most the query's norm times the norm of what quantising left
over, so every vector that may be among a shard's k nearest is known, however many share a code; all of them are ranked in the
task by the exact inner product of the original vectors, in double precision, and a shard's k nearest go on.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another length than the
most common one (no inner product with the others is defined); rows that repeat a vec_id count once (the smallest vector); ties go to the
smaller vec_id; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, write_table

#: Vectors that centroids and codebooks are fitted on, at most: the first in the order of a hash of their ids.
SAMPLE = 20_000
#: Lists, at least and at most.
LISTS = (16, SAMPLE // 8)
CODEWORDS = 256
SUBSPACE = 4
#: Share of the true neighbours of TRIALS sampled queries that the visited lists must hold.
RECALL, TRIALS = 0.97, 256
#: Vectors in a shard, about at most, queries that a copy of it serves, and shards, at least (so that small tables are searched in parallel).
BLOCK, QUERIES, LEAST_SHARDS = 100_000, 20_000, 16
#: Bytes of the vectors of the sample, of a shard and of a copy's queries, at most: long vectors make these fewer.
BYTES = 128 << 20


@dataclass
class Codes:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codewords x width

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code (one byte a subspace) of each vector."""
        at = nearest(x, self.centroids)
        rest = (x - self.centroids[at]).reshape(len(x), len(self.books), -1)
        return at, np.stack([nearest(rest[:, m], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)

    def left_over(self, x: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Norm of the difference between each vector and what its list and code stand for, rounded up."""
        parts = self.books[np.arange(len(self.books)), code].reshape(len(x), -1)
        return np.linalg.norm(x - self.centroids[at] - parts, axis=1) + 1e-9 * (1 + np.linalg.norm(x, axis=1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords: queries x subspaces x codewords."""
        return np.einsum("qmw,mkw->qmk", q.reshape(len(q), len(self.books), -1), self.books)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = (x[i : i + 8192] @ centres.T - half).argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, weights=c, minlength=len(centres)) for c in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(x: np.ndarray, lists: int) -> Codes:
    dim = x.shape[1]
    width = SUBSPACE if dim % SUBSPACE == 0 else 1
    centroids = kmeans(x, lists, 1)
    # near lists beside one another: in order along the direction in which the centroids differ most
    centroids = centroids[np.argsort(centroids @ np.linalg.svd(centroids - centroids.mean(axis=0), full_matrices=False)[2][0], kind="stable")]
    rest = (x - centroids[nearest(x, centroids)]).reshape(len(x), dim // width, width)
    books = [kmeans(np.ascontiguousarray(rest[:, m]), CODEWORDS, m) for m in range(dim // width)]
    return Codes(centroids, np.stack(books))


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part, one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    own = own.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    own = own.groupBy("vec_id").agg(F.min("v").alias("v"))
    common = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.where(F.size("v") == (common["n"] if common else 0))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _encode(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stack(batch.column("v"))
                at, code = codes.assign(x)
                cols = [pa.array(at), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(codes.left_over(x, at, code)), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *cols], ["vec_id", "list", "code", "err", "x"])

    return run


def lists_to_visit(codes: Codes, x: np.ndarray, k: int, recall: float) -> int:
    """How many lists the first TRIALS vectors of the sample x must visit to meet `recall` of their k nearest in it."""
    q = x[:TRIALS]
    s = x @ q.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argpartition(-s, min(k, len(x) - 1), axis=0)[:k].T  # queries x k
    order = np.argsort(-(q @ codes.centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    met = np.sort(np.take_along_axis(rank, nearest(x, codes.centroids)[near], axis=1).ravel())
    return int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) + 1 if len(met) else 1


def visits(codes: Codes, q: np.ndarray, probe: int, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which lists each query visits (queries x lists): `probe` of them, and as many more as it takes to meet `least` vectors."""
    order = np.argsort(-(q @ codes.centroids.T), axis=1, kind="stable")
    n = np.maximum(probe, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, np.arange(order.shape[1]) < n[:, None], axis=1)
    return out


def _ask(codes: Codes, probe: int, sizes: np.ndarray, least: int, width: int):
    """A row for each shard that holds lists which the query visits, with their numbers."""
    ends = np.cumsum(sizes)
    first, last = (ends - sizes) // width, np.maximum(ends - 1, 0) // width
    shards = np.arange(int(last.max(initial=0)) + 1)
    low, high = np.searchsorted(last, shards), np.searchsorted(first, shards, "right")  # the lists of a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                q = _stack(part.column("v"))
                visited = visits(codes, q, probe, sizes, least) & (sizes > 0)
                asks = [(i, s, np.nonzero(row[low[s] : high[s]])[0] + low[s]) for i, row in enumerate(visited) for s in shards]
                asks = [(i, s, lists) for i, s, lists in asks if len(lists)]
                raw = [v.tobytes() for v in q]
                cols = [pa.array([raw[i] for i, _, _ in asks], pa.binary()), pa.array([s for _, s, _ in asks], pa.int64()), pa.array([x.astype(np.int32).tobytes() for _, _, x in asks], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array([i for i, _, _ in asks], pa.int64())), *cols], ["query_id", "q", "shard", "lists"])

    return run


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, added from the first component on: equal vectors have equal ones."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += x[:, j] * q[j]
    return out


def top(s: np.ndarray, k: int) -> float:
    """The k-th largest of s, or the least if there are fewer."""
    return np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else s.min(initial=np.inf)


def _scan(codes: Codes, k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(shard):
            return empty
        shard = shard.sort_values(["list", "vec_id"])
        ids, err = shard["vec_id"].to_numpy(np.int64), shard["err"].to_numpy(float)
        lists, length = np.unique(shard["list"].to_numpy(np.int64), return_counts=True)  # codes of a list stand together
        code = np.frombuffer(b"".join(shard["code"]), np.uint8).reshape(len(ids), -1)
        code = code + np.arange(code.shape[1]) * codes.books.shape[1]  # into a table laid flat
        x = np.frombuffer(b"".join(shard["x"]), np.float64).reshape(len(ids), -1)
        del shard
        out = [empty]
        for i in range(0, len(queries), 64):
            part = queries.iloc[i : i + 64]
            q = np.frombuffer(b"".join(part["q"]), np.float64).reshape(len(part), -1)
            all_exact = None
            coarse = q @ codes.centroids[lists].T  # of the lists that stand in this shard
            for n, (query, table, visited) in enumerate(zip(part["query_id"].to_numpy(np.int64), codes.tables(q), part["lists"])):
                visited = np.isin(lists, np.frombuffer(visited, np.int32), assume_unique=True)
                met = np.nonzero(np.repeat(visited, length) & (ids != query))[0]
                if not len(met):
                    continue
                s = np.repeat(coarse[n], length)[met] + table.ravel()[code[met]].sum(axis=1)
                slack = np.linalg.norm(q[n]) * err[met]
                # a vector whose highest possible score is below the k-th lowest possible one isn't among the k nearest
                met = met[s + slack >= top(s - slack, k)]
                if len(met) * 16 > len(ids):  # one matrix product for all queries is less work than picking rows for each
                    all_exact = x @ q.T if all_exact is None else all_exact
                    rough = all_exact[met, n]
                else:
                    rough = x[met] @ q[n]
                # matrix products round as they please: what is near the edge is added up in order
                met = met[rough >= top(rough, k) - 1e-9 * (1 + np.abs(rough).max(initial=0))]
                exact = products(x[met], q[n])
                best = np.lexsort((ids[met], -exact))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[met[best]], "score": exact[best]}))
        return pd.concat(out)

    return run


def search(rows: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other vectors."""
    own = write_table(vectors(rows), "vectors")
    spark, total = own.sparkSession, own.count()
    any_one = own.select(F.size("v")).first()
    if any_one is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitting = max(1, BYTES // (8 * any_one[0]))  # vectors of this length in BYTES
    x = _stack(own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, fitting)).select("v").toArrow().column("v").combine_chunks())
    codes = fit(x, int(np.clip(round(total**0.5), *LISTS)))
    probe = lists_to_visit(codes, x, k, recall)
    coded = write_table(own.mapInArrow(_encode(codes), "vec_id long, list long, code binary, err double, x binary"), "codes")
    sizes = np.zeros(len(codes.centroids), np.int64)
    for r in coded.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    width = max(1, min(block, fitting, -(-total // LEAST_SHARDS)))
    queries = min(queries, fitting)
    asked = write_table(own.where(is_query).mapInArrow(_ask(codes, probe, sizes, k + 1, width), "query_id long, q binary, shard long, lists binary"), "asked")
    loads = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(queries)).cast("int").alias("copies")))  # a row for each shard: total / width
    place = spark.createDataFrame([(i, int(e - n), int(n)) for i, (n, e) in enumerate(zip(sizes, np.cumsum(sizes)))], "list long, before long, size long")
    # where in its list a vector stands goes by a hash of its id
    within = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) / float(1 << 40) * F.col("size"))
    held = coded.join(F.broadcast(place), "list").withColumn("shard", F.floor((F.col("before") + within) / F.lit(width)).cast("long")).drop("before", "size")
    held = held.join(loads, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = asked.join(loads, "shard").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int")).drop("copies")
    found = dealt.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy"))
    near = found.applyInPandas(_scan(codes, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
