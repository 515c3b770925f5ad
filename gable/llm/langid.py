"""Operator 1, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the whole lower-cased text are hashed to DIM columns. Document frequencies are counted over all documents that
may be learned from. The weights are trained with follow-the-regularised-leader (FTRL-proximal) and elastic-net penalties on a
bounded sample of labelled rows for each language (SAMPLE), part of which is set aside to fit one temperature for the
scores. Prediction is one pass over the texts in Arrow batches.

Cases: null text, or text without a letter: `und`, score 0; no labelled rows at all: `und`, score 0 for every row; a null doc_id
is not held out and never learned from; a null lang is never learned from. Document frequencies count repeated rows as often as they occur;
the sample takes each doc_id and lang once (the smallest text). A lang column of over 1,000 values is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, may_learn, slices

DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Labelled rows that the weights are fitted on, at most: for each language, and in all.
SAMPLE, SAMPLE_ROWS = 800, 32_000
#: One in so many sampled rows fits the temperature instead of the weights.
CALIBRATE = 5
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_columns(text: str) -> np.ndarray:
    """Columns of all 1- to 3-grams of the lower-cased text, which is padded with a space on either side."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
            if n in ORDERS and len(h):
                x = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)
                out.append((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14))
    return np.concatenate(out)


def gram_counts(text: str) -> np.ndarray:
    return np.bincount(gram_columns(text), minlength=DIM)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for part in slices(batch, 500):
            for t in part.column("text").to_pylist():
                if t is not None:
                    df += gram_counts(t) > 0
                    n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIM), -1)), pa.array(np.append(df, n))], ["col", "df"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 200):
            cols, tfs = [], []
            for t in part.column("text").to_pylist():
                counts = gram_counts(t or "")
                at = np.nonzero(counts)[0]
                cols.append(at.astype(np.int32))
                tfs.append(counts[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(cols, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "lang", "cols", "tfs"])


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.nonzero(counts)[0]
        return self.sparse_logits(at, counts[at])

    def sparse_logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf) * self.idf[at]
        norm = np.sqrt(x @ x)
        return (x @ self.weights[at]) / (norm or 1.0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(gram_counts(text)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the multinomial loss. rows: columns, values, class. The last column is the bias, which isn't penalised."""
    z, n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        w[-1] = -zi[-1] / ((beta + np.sqrt(n[at[-1]])) / alpha)
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            cols, x, y = rows[i]
            at, v = np.append(cols, dim), np.append(x, 1.0)
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(dim + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search on a grid that is refined twice."""
    lo, hi = -3.0, 3.0
    for _ in range(3):
        grid = np.linspace(lo, hi, 41)
        loss = [-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        k = int(np.argmin(loss))
        lo, hi = grid[max(0, k - 1)], grid[min(40, k + 1)]
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> LanguageModel:
    """Learns from rows where `learn` holds: their texts give the document frequencies, at most `sample` rows a language the weights."""
    learn = may_learn() if learn is None else learn
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learn)
    counted = known.select("text").mapInArrow(_frequencies, "col long, df long").groupBy("col").agg(F.sum("df").alias("df")).collect()  # DIM + 1 rows
    labelled = known.where("lang is not null and text is not null")
    # the ids of the sample are chosen without the texts
    ids = F.broadcast(bounded_sample(labelled, "lang", sample, total=SAMPLE_ROWS))
    chosen = labelled.join(ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = chosen.mapInArrow(_examples, "doc_id long, lang string, cols array<int>, tfs array<int>").toPandas()
    df = np.zeros(DIM)
    n = 0
    for r in counted:
        if r["col"] >= 0:
            df[r["col"]] = r["df"]
        else:
            n = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = sorted(set(rows["lang"]))
    model = LanguageModel(langs, idf, np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    if not langs:
        return model
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    data = []
    for cols, tfs, lang in zip(rows["cols"], rows["tfs"], rows["lang"]):
        x = np.log1p(np.asarray(tfs, float)) * idf[cols]
        data.append((np.asarray(cols), x / (np.sqrt(x @ x) or 1.0), langs.index(lang)))
    fold = np.arange(len(data)) % CALIBRATE == 0 if len(data) >= 5 * CALIBRATE else np.zeros(len(data), bool)
    model.weights, model.bias = ftrl([d for d, f in zip(data, fold) if not f], DIM, len(langs))
    if fold.any():
        aside = [d for d, f in zip(data, fold) if f]
        model.temperature = temperature(np.array([x @ model.weights[c] + model.bias for c, x, _ in aside]), np.array([y for _, _, y in aside]))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the calibrated probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 500):
                found = [m.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_told(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language can be told, all columns as they were; a model that has learned no language drops only what has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 500):
                texts = part.column("text").to_pylist()
                told = [m.predict(t)[0] != UNKNOWN if m.langs else has_letter(t) for t in texts]
                yield part.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
