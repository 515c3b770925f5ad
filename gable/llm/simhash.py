"""Operator 7, SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a fixed vector of r+1 bits; table v (every non-zero vector) keeps the positions whose vector has an
odd inner product with v. Up to r positions span at most r dimensions, so some v is orthogonal to all of them: in that table any
two fingerprints that differ in these positions only have the same masked value. So every pair within radius r = 4 meets in at
least one of the 31 tables, whatever the data.

Rows with the same fingerprint are one class first (aggregated in the map tasks). Only classes enter the tables. In each bucket
fingerprints are compared in vectorised blocks and a spanning forest of the links found is returned, not all pairs. Buckets
that are too large for a task are cut into blocks, each pair of blocks a task of its own. Components then come from alternating
large-star and small-star steps on the class graph.

Cases: a text without words (null and empty ones too) has fingerprint zero and is linked like any other; repeated rows are in
one class; a null doc_id never is a component's id unless all ids in it are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, keep_rows, slices, text_hash, text_only, write_table

RADIUS = 4
SHINGLE = 4
#: Class fingerprints of a bucket that one task compares; a larger bucket is cut into blocks of this size.
BLOCK = 8192


def masks(radius: int = RADIUS, seed: int = 11) -> list[int]:
    """The 2^(radius+1) - 1 covering masks over 64 bits. Vectors are dealt evenly, so that every mask keeps about half of the bits."""
    dim = radius + 1
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.permutation(np.arange(1, 1 << dim)) for _ in range(3)])[:64]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(int(m) & v).count("1") % 2) for v in range(1, 1 << dim)]


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [h(joined, 42)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    first = [0, *(e + 1 for e in ends[: -SHINGLE])]
    return [h(joined[a:b], 42) for a, b in zip(first, ends[SHINGLE - 1 :])]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8")
    for i in range(0, len(packed), 65536):
        counts += np.unpackbits(packed[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(packed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 500):
            fp = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return text_only(docs, text_hash().alias("text_hash")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component; a and b are the ends of the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of x and y that differ in at most radius bits, compared in blocks of about four million."""
    left, right, step = [], [], max(1, (1 << 22) // max(1, len(y)))
    for i in range(0, len(x), step):
        near = np.bitwise_count(x[i : i + step, None] ^ y[None, :]) <= radius
        p, q = np.nonzero(near)
        left.append(p + i)
        right.append(q)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(fp: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fingerprints of both ends) of the links in one bucket, or between two blocks of it."""
    both = fp if other is None else np.concatenate([fp, other])
    label = np.arange(len(both))
    second, shift = (fp, 0) if other is None else (other, len(fp))
    step = max(1, (1 << 21) // max(1, len(second)))
    for i in range(0, len(fp), step):
        p, q = close_pairs(fp[i : i + step], second, radius)
        p, q = label[p + i], label[q + shift]
        apart = p != q
        p, q = p[apart], q[apart]
        if len(p):
            label = _min_labels(len(both), np.concatenate([np.arange(len(both)), p]), np.concatenate([label, q]))
    linked = label != np.arange(len(both))
    return both[linked], both[label[linked]]


def _small_runs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forests of all runs of equal keys at once: each fingerprint is compared with the k-th after it, for every k."""
    n, a, b = len(key), [], []
    for k in range(1, n):
        same = key[:-k] == key[k:]
        if not same.any():
            break
        i = np.nonzero(same)[0]
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= radius]
        a.append(i)
        b.append(i + k)
    if not a:
        return fp[:0], fp[:0]
    label = _min_labels(n, np.concatenate(a), np.concatenate(b))
    linked = label != np.arange(n)
    return fp[linked], fp[label[linked]]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and masked value; a bucket may span batches."""
        kept_k, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        kept_t = np.zeros(0, np.int64)

        def links(t, k, f):
            edges = []
            if len(t) == 0:
                return edges
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            start = np.nonzero(new)[0]
            sizes = np.diff(np.append(start, len(t)))
            group = np.repeat(np.arange(len(start)), sizes)
            small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
            if small.any():
                edges.append(_small_runs(group[small], f[small], radius))
            for s, n in zip(start[sizes > 64], sizes[sizes > 64]):
                edges.append(_forest(f[s : s + n], None, radius))
            return edges

        def out(edges):
            for x, y in edges:
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            t = np.concatenate([kept_t, batch.column("tbl").to_numpy().astype(np.int64)])
            k = np.concatenate([kept_k, batch.column("masked").to_numpy()])
            f = np.concatenate([kept_f, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(t):
                continue
            # what may go on in the next batch waits
            other = np.nonzero((t != t[-1]) | (k != k[-1]))[0]
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from out(links(t[:cut], k[:cut], f[:cut]))
            kept_t, kept_k, kept_f = t[cut:], k[cut:], f[cut:]
        yield from out(links(kept_t, kept_k, kept_f))

    return run


def _block_links(radius: int):
    def run(key, pdf):
        x = pdf.loc[pdf["side"] == 0, "fp"].to_numpy(np.int64).view(np.uint64)
        y = pdf.loc[pdf["side"] == 1, "fp"].to_numpy(np.int64).view(np.uint64)
        a, b = _forest(x, y if key[2] != key[3] else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def class_links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b: fingerprints) whose components are those of all pairs of classes within the radius."""
    spark = classes.sparkSession
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    rows = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("tbl"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked")) for i, m in enumerate(signed)])).alias("x"))
    rows = rows.select(F.col("x.tbl").cast("int").alias("tbl"), F.col("x.masked").alias("masked"), "fp")
    # Large buckets: at most 31 x classes / block of them, so the list that is broadcast stays small beside the data; it is checked.
    large = write_table(rows.groupBy("tbl", "masked").count().where(F.col("count") > block), "large")
    n_large = large.count()
    part = ["tbl", "masked"]
    if n_large:
        near = F.broadcast(large) if n_large <= 100_000 else large
        ordinary = rows.join(near.drop("count"), part, "left_anti")
    else:
        ordinary = rows
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "a long, b long"
    found = ordinary.repartition(n, *part).sortWithinPartitions(*part).mapInArrow(_bucket_links(radius), schema)
    if n_large:
        cut = rows.join(near, part).withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int"))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        # every block meets every block, itself too: a row goes to one task for each block of its bucket
        cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cut = cut.select("tbl", "masked", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
        found = found.unionByName(cut.groupBy("tbl", "masked", "i", "j").applyInPandas(_block_links(radius), schema))
    return found.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """node, root: the smallest node of each component, for every node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until nothing changes, which takes about log2(nodes) rounds;
    if `rounds` were not enough, that is an error. Each round is written to the shared folder. A node's smallest neighbour is
    found by a partial aggregation, and joined map-side for nodes with very many neighbours, so these are no single task's work.
    """
    e = write_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    before, n = None, e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        # large star: each larger neighbour is linked with the smallest
        joined = join_counted(both.where("v > u"), low, "u", "n", n)
        e = write_table(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
        # small star: the node and its smaller neighbours are linked with the smallest
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_counted(e, low, "u", "n", n)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = write_table(small, "small-star")
        n, check = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, check)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, class_size, component_docs, kept and text_hash of every document.

    One row of each component is kept: that of the smallest doc_id; of rows that share it, that of the smallest fingerprint, then row.
    """
    rows = write_table(fingerprints(docs).withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    total = rows.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))  # a null id comes last
    classes = write_table(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("class_size")), "classes")
    roots = components(write_table(class_links(classes, radius, block), "links"))
    own = write_table(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    best = F.min(F.struct("first.none", "first.doc_id", "fp", "first.uid"))
    sums = own.groupBy("root").agg(best.alias("best"), F.sum("class_size").alias("component_docs"), F.count("*").alias("n"))
    joined = join_counted(own, sums, "root", "n", own.count())
    own = write_table(joined.select("fp", "class_size", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("kept_uid"), "component_docs"), "class-components")
    return join_counted(rows, own, "fp", "class_size", total).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size", "component_docs", (F.col("uid") == F.col("kept_uid")).alias("kept"), "text_hash",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, all columns as they were."""
    return keep_rows(docs, write_table(near_duplicates(docs).select("doc_id", "text_hash", "kept"), "near"))
