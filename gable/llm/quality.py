"""Operator 5, quality classifier by importance resampling over hashed n-grams.

Two generative models over hashed token unigrams and bigrams (BUCKETS columns, add-one smoothing): of target text (documents labelled
good, on the learning side) and of raw text (all documents). The importance weight of a document is the ratio of the two; its
logarithm, taken for each n-gram, ranks documents whatever their length (sums over n-grams would let long texts win or lose by length
alone). Documents are drawn without replacement by Gumbel top-k: the k largest of log weight / temperature + Gumbel noise, the noise a
function of the row's id and text, so that a repeated task draws alike. The temperature is fitted: the highest of TEMPERATURES at which the draw is expected
to keep GOOD_KEPT of the labelled good documents. So chance decides as widely around the k-th weight as the labels bear.

k is no constant: it is the share of documents above the weight that parts good from bad labels best (see `keep_share`). The k-th key is
found by counting keys in a fixed number of bins, then ranking inside one bin; no task sorts all rows.

At most TARGET documents, the first by a hash of their ids, fit the target model.

Cases: null and empty texts have no n-grams and log weight 0 (neither model prefers them); a null doc_id has noise like any other
row; without labels everything is kept; ties in the key go to the smaller doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, bounded_sample, by_bytes, joined_bytes, keep_rows, may_learn, mix64, slices, text_hash, text_only, write_table

BUCKETS = 1 << 16
#: Labelled documents that the target model is fitted on, at most (their ids are broadcast: 8 MB).
TARGET = 1_000_000
#: Log weights for each n-gram are divided by one of these before the noise is added: the first that keeps so much of the labelled good documents.
TEMPERATURES = tuple(2.0 ** (-i / 2) for i in range(17))
GOOD_KEPT = 0.995
#: Bins in which keys are counted to find the k-th largest.
BINS = 4096
#: Rows among which the k-th largest is found by sorting, at most (but for equal keys).
EDGE = 50_000

#: Added to the number of n-grams when weights are averaged: short texts stay near 0, where neither model is preferred.
SHRINK = 8
REPEATED = np.uint64(0xFFFF << 48)

def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each unigram and bigram of the texts, and the index of its text."""
    cols, docs = [], []
    for i, j in by_bytes(texts):
        data, at = joined_bytes(texts[i:j])
        tokens = Tokens(data)
        h = tokens.hashes(tokens.starts, tokens.ends)
        doc = np.searchsorted(at, tokens.starts, "right") - 1
        pair = doc[1:] == doc[:-1]
        with np.errstate(over="ignore"):
            two = mix64(h[:-1] * np.uint64(3) + h[1:], 1) if len(h) else h
        if len(h):  # a token after itself is one event, whatever the token
            two = np.where(h[:-1] == h[1:], REPEATED, two)[pair]
        cols += [h >> np.uint64(48), two >> np.uint64(48)]
        docs += [doc + i, doc[1:][pair] + i]
    return np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64), np.concatenate(docs) if docs else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, 500):
            cols, docs = gram_buckets(part.column("text").to_pylist())
            good = np.array(part.column("good").to_pylist(), bool)
            raw += np.bincount(cols, minlength=BUCKETS)
            target += np.bincount(cols[good[docs]], minlength=BUCKETS)
    seen = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["col", "raw", "target"])


def log_ratio(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log p(n-gram | target) - log p(n-gram | raw) by bucket; counts cover all of docs. good: ids of at most TARGET target documents."""
    marked = text_only(docs).join(F.broadcast(good.select("doc_id").distinct().withColumn("good", F.lit(True))), "doc_id", "left")
    found = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count, "col long, raw long, target long")
    rows = found.groupBy("col").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for c, r, t in rows:
        raw[c] += r
        target[c] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight (the mean over the document's n-grams) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            for part in slices(batch, 500):
                cols, owner = gram_buckets(part.column("text").to_pylist())
                n = np.bincount(owner, minlength=part.num_rows)
                s = np.bincount(owner, weights=r[cols], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(s / (n + SHRINK))], ["doc_id", "text_hash", "n_grams", "log_weight"])

    return text_only(docs, text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_grams long, log_weight double")


def gumbel(seed: int = 0) -> Column:
    """Standard Gumbel noise that depends on the row's id and text alone."""
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text_hash"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, k: int, total: int, few: int = EDGE) -> DataFrame:
    """rows with `selected`: true for the k largest keys (ties: smaller doc_id).

    Keys are counted in BINS bins; the bin that holds the k-th is cut into bins again, until it holds at most `few` rows or only
    equal keys. Only these rows are sorted.
    """
    if k >= total:
        return rows.withColumn("selected", F.lit(True))
    lo, hi = rows.agg(F.min("key"), F.max("key")).first()
    left, inside = k, rows
    while lo < hi:
        width = (hi - lo) / BINS
        at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("key") - lo) / width))).cast("int")
        counted = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # BINS rows
        for r in sorted(counted, key=lambda r: -r["bin"]):
            if r["n"] > left:
                break
            left -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi = r["lo"], r["hi"]
        inside = rows.where(F.col("key").between(lo, hi))
        if r["n"] <= few:
            break
    if not left:
        return rows.withColumn("selected", F.col("key") > hi)
    # the last row drawn: the left-th of the edge by key, then id; null ids first
    last = inside.select("key", "doc_id").orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).limit(left).orderBy("key", F.desc_nulls_last("doc_id")).limit(1).first()
    same = F.coalesce(F.col("doc_id") <= F.lit(last["doc_id"]), F.lit(True)) if last["doc_id"] is not None else F.col("doc_id").isNull()
    return rows.withColumn("selected", (F.col("key") > last["key"]) | ((F.col("key") == last["key"]) & same))


def resample(docs: DataFrame, labels: DataFrame, temperature: float | None = None) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, temperature, key and selected of every document. Labels are learned from rows that may be learned from only.

    temperature: that of the draw, fitted if it isn't given.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(may_learn()).where("quality is not null and doc_id is not null")
    good = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    target = bounded_sample(good.where("quality = 1"), "quality", TARGET)
    scored = write_table(weights(docs, log_ratio(docs, target)), "weights")
    # Labels may cover other documents than these: what is fitted is fitted on labelled documents that are here.
    spread = scored.groupBy(F.round("log_weight", 4).alias("w")).agg(F.count("*").alias("n"))
    labelled = scored.join(good, "doc_id").groupBy(F.round("log_weight", 4).alias("w")).agg(F.count("*").alias("labelled"), F.sum("quality").alias("good"))
    # a row for each rounded weight: some thousands, whatever the corpus
    found = np.array([[float(x or 0) for x in r] for r in spread.join(labelled, "w", "left").select("w", "n", "labelled", "good").orderBy("w").collect()]).reshape(-1, 4)
    w, n, good_n, bad_n = found[:, 0], found[:, 1], found[:, 3], found[:, 2] - found[:, 3]
    k = round(keep_share(n, good_n, bad_n) * n.sum())
    if temperature is None:
        temperature = next((t for t in TEMPERATURES if expected_kept(w, n, good_n, k, t) >= GOOD_KEPT), TEMPERATURES[-1])
    scored = scored.withColumn("temperature", F.lit(float(temperature))).withColumn("key", F.col("log_weight") / temperature + gumbel())
    return top_k(scored, k, int(n.sum()))


def keep_share(n: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The share of all documents to draw: those over the weight that parts good from bad labels best. All by ascending weight."""
    if not good.sum() or not bad.sum():
        return 1.0
    kept_good, dropped_bad = 1 - np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    # a good document lost weighs as much as several bad ones kept
    k = int((20 * kept_good + dropped_bad).argmax())
    return float(n[k + 1 :].sum() / n.sum()) if 20 * kept_good[k] + dropped_bad[k] > 20 else 1.0


def expected_kept(w: np.ndarray, n: np.ndarray, good: np.ndarray, k: int, temperature: float) -> float:
    """The share of good documents among the k drawn of n documents by weight, expected."""
    if k >= n.sum() or not good.sum():
        return 1.0
    drawn = lambda t: -np.expm1(-np.exp(np.minimum(w / temperature - t, 700)))  # noqa: E731  P(noise > t - w / temperature)
    low, high = w.min() / temperature - 50, w.max() / temperature + 50
    for _ in range(80):  # the key that k documents are expected to exceed
        t = (low + high) / 2
        low, high = (t, high) if (n * drawn(t)).sum() > k else (low, t)
    return float((good * drawn(low)).sum() / good.sum())


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that were drawn, all columns as they were."""
    return keep_rows(docs, write_table(resample(docs, labels).select("doc_id", "text_hash", F.col("selected").alias("kept")), "resampled"))
