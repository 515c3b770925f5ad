"""Operator 6, toxicity from the nearest labelled examples under exact TF-IDF cosine.

Terms are the words and runs of signs of a text (lower-cased), and the beginnings (four characters) of longer words. All terms of a bounded
sample of labelled rows (EXAMPLES) are columns, none is left out; terms that no example holds have no column. Document
frequencies are counted over all texts. A term's weight is (1 + log tf) x idf x the strength of its association with the
label in the examples (root of chi-square): over plain TF-IDF whole texts are near one another by what they have in common by chance
(README gives both figures). Examples are unit vectors in an inverted index: for each term postings by blocks of 64 examples, and for each
block of a term the largest weight in it; terms that many examples hold are whole columns, multiplied for a slice of texts at once. A
text's blocks are visited from the highest upper bound down, and all whose bound reaches the K-th cosine found are read: the K nearest are exact. Votes weighted by cosine give a raw score, which a monotone curve fitted on
the examples themselves (each without its own vote, weighted as its label is among all labelled rows) turns into a probability. The nearest
examples are returned as evidence.

Cases: null and empty texts, and texts without any of the terms, have no neighbour and get the share of label 1 among labelled
rows; without labels every score is 0; with one label only, terms have their TF-IDF weight alone; repeated labels of one doc_id count once
(toxic if any is); rows that repeat an example's doc_id are one example (the smallest text); a null doc_id isn't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, bounded_sample, by_bytes, held_out, joined_bytes, may_learn, slices, text_only, write_table

#: Labelled rows of each label that are examples, at most.
EXAMPLES = 2000
K = 15
BLOCK = 64
#: Blocks that are read first, before the bound of the others is known.
FIRST = 4
THRESHOLD = 0.7
#: Terms that more than one in so many examples holds are whole columns.
COMMON = 12
#: Characters of a word's beginning that is a term of its own.
BEGINNING = 4
EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every occurrence of a term, and the index of its text."""
    data, at = joined_bytes([(t or "").lower() for t in texts])
    tokens = Tokens(data)
    owner = np.searchsorted(at, tokens.starts, "right") - 1
    # beginnings end where their fifth character starts
    characters = np.nonzero((data & 0xC0) != 0x80)[0]
    number = np.searchsorted(characters, tokens.starts)
    stop = np.append(characters, np.full(BEGINNING, len(data)))[number + BEGINNING] if len(number) else tokens.starts
    longer = tokens.word & (stop < tokens.ends)
    whole = tokens.hashes(tokens.starts, tokens.ends)
    begins = tokens.hashes(tokens.starts[longer], stop[longer], 1)
    return np.concatenate([whole, begins]), np.concatenate([owner, owner[longer]])


def term_counts(texts: list[str | None], vocabulary: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text in order: the hash of each term (place in the vocabulary, if one is given), and how often it occurs; sorted."""
    for i, j in by_bytes(texts):
        h, owner = term_hashes(texts[i:j])
        if vocabulary is not None:
            place = np.searchsorted(vocabulary, h)
            known = place < len(vocabulary)
            known[known] = vocabulary[place[known]] == h[known]
            h, owner = place[known], owner[known]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        first = np.nonzero(new)[0]
        tf = np.diff(np.append(first, len(h)))
        cuts = np.searchsorted(owner[first], np.arange(j - i + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield h[first[a:b]], tf[a:b]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 200):
            found = list(term_counts(part.column("text").to_pylist()))
            cols = [pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *cols], ["doc_id", "toxic", "term", "tf"])


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows each term of the vocabulary occurs, and the number of rows. A task sends its sums, a row for each term met."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of the examples, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in slices(batch, 500):
                for at, _ in term_counts(part.column("text").to_pylist(), known):
                    df[at] += 1
                    n += 1
        met = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(df[met], n))], ["term", "df"])

    counted = text_only(docs).select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term
    term, count = counted["term"].to_numpy(), counted["df"].to_numpy()
    df = np.zeros(len(vocabulary), np.int64)
    df[term[term >= 0]] = count[term >= 0]
    return df, int(count[term < 0].sum())


def association(at: np.ndarray, labels: np.ndarray, bad: int, n: int, size: int) -> np.ndarray:
    """Root of chi-square of each term's presence and the label, over the examples (bad of n); 1 for all where there is one label only.

    at, labels: the term and its example's label, of each example's each term.
    """
    if bad in (0, n):
        return np.ones(size)
    a, b = (np.bincount(at[labels == y], minlength=size).astype(float) for y in (1, 0))
    below = (a + b) * (n - a - b) * bad * (n - bad)
    return np.sqrt(n * (a * (n - bad - b) - b * (bad - a)) ** 2 / np.where(below > 0, below, 1)) * (below > 0)


class Index:
    """Exact nearest examples by cosine, from postings with block maxima. weight: of each term; counts: terms and tf of each example."""

    def __init__(self, weight: np.ndarray, ids: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float = 0.0):
        self.weight, self.prior = weight, prior
        vectors = [self.vector(*c) for c in counts]
        # examples of the same strongest term stand together, which makes the maxima of their blocks tight
        order = sorted((i for i, (at, _) in enumerate(vectors) if len(at)), key=lambda i: (vectors[i][0][vectors[i][1].argmax()], ids[i]))
        self.vectors = [vectors[i] for i in order]
        del vectors
        self.ids, self.labels = np.asarray(ids, np.int64)[order], np.asarray(labels, np.int64)[order]
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([at for at, _ in self.vectors]) if order else np.zeros(0, np.int64)
        value = np.concatenate([x for _, x in self.vectors]) if order else np.zeros(0)
        row = np.repeat(np.arange(len(order)), [len(at) for at, _ in self.vectors])
        common = np.bincount(term, minlength=len(weight)) * COMMON > len(order)
        self.column = np.where(common, np.cumsum(common) - 1, -1)  # of each common term in the whole columns
        self.columns = np.zeros((int(common.sum()), len(order)))
        whole = common[term]
        self.columns[self.column[term[whole]], row[whole]] = value[whole]
        term, value, row = term[~whole], value[~whole], row[~whole]
        by = np.argsort(term, kind="stable")  # by term, then row
        self.rows, self.values = row[by].astype(np.int32), value[by]
        term, block = term[by], row[by] // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.starts = np.append(np.nonzero(new)[0], len(term)).astype(np.int32)  # postings of each (term, block)
        self.block_of = block[new].astype(np.int32)
        self.block_max = np.maximum.reduceat(self.values, self.starts[:-1]) if len(term) else np.zeros(0)
        self.entries = np.searchsorted(term[new], np.arange(len(weight) + 1)).astype(np.int32)  # (term, block)s of each term
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vector(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of positive weight and unit weights of a whole text."""
        x = (1 + np.log(tf)) * self.weight[at]
        at, x = at[x > 0], x[x > 0]
        return at, x / np.sqrt(x @ x) if len(x) else x

    def _cosines(self, entry: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What the postings of some (term, block)s add to each example's cosine; x: the text's weight of each."""
        first, n = self.starts[entry], self.starts[entry + 1] - self.starts[entry]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.rows[at], weights=self.values[at] * np.repeat(x, n), minlength=len(self.ids))

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms of each vector add to each example's cosine."""
        q = np.zeros((len(vectors), len(self.columns)))
        for i, (at, x) in enumerate(vectors):
            c = self.column[at]
            q[i, c[c >= 0]] = x[c >= 0]
        return q @ self.columns

    def nearest(self, at: np.ndarray, x: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples (positive cosines only), nearest first, ties to the smaller id. base: its common part."""
        rare = self.column[at] < 0
        at, x = at[rare], x[rare]
        n = self.entries[at + 1] - self.entries[at]
        entry = np.repeat(self.entries[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        each = np.repeat(x, n)
        block = self.block_of[entry]
        bounds = np.bincount(block, weights=self.block_max[entry] * each, minlength=self.blocks) + np.maximum.reduceat(base, np.arange(0, len(base), BLOCK))
        ahead = np.zeros(self.blocks, bool)
        ahead[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        now = ahead[block]
        sims = base + self._cosines(entry[now], each[now])  # exact in the blocks read, a lower bound elsewhere
        floor = np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) > k else 0.0
        rest = ~ahead & (bounds > 0) & (bounds >= floor - 1e-12)
        now = rest[block]
        if now.any():
            sims += self._cosines(entry[now], each[now])
        some = np.nonzero(sims >= max(np.partition(sims, len(sims) - k)[len(sims) - k] - 1e-11 if len(sims) > k else 0.0, 1e-300))[0]
        best = some[np.lexsort((self.ids[some], -np.round(sims[some], 12)))[:k]]
        return best, sims[best]

    def raw(self, rows: np.ndarray, sims: np.ndarray) -> float:
        return float((sims * self.labels[rows]).sum() / sims.sum()) if len(rows) else 0.0

    def calibrate(self, share: dict[int, float]) -> None:
        """Fits the curve by pooling adjacent violators on each example's score without its own vote. share: the weight of an example of each label."""
        scores = np.zeros(len(self.ids))
        for i in range(0, len(self.vectors), 500):
            part = self.vectors[i : i + 500]
            for r, ((at, x), base) in enumerate(zip(part, self.common_part(part)), i):
                rows, sims = self.nearest(at, x, base, K + 1)
                scores[r] = self.raw(rows[rows != r][:K], sims[rows != r][:K])
        levels: list[list[float]] = []  # sums over examples, weighted: labels, examples, scores
        for s, y in sorted(zip(scores.tolist(), self.labels.tolist())):
            w = share.get(y, 1.0)
            levels.append([w * y, w, w * s])
            while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
                a = levels.pop()
                levels[-1] = [p + q for p, q in zip(levels[-1], a)]
        if levels:
            x = np.array([s / n for _, n, s in levels])
            y = np.array([(t + 0.5 * self.prior) / (n + 0.5) for t, n, _ in levels])
            self.curve = (x, np.maximum.accumulate(y))

    def scores(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[dict]]]:
        """Score and evidence of each text, from its terms and tf."""
        vectors = [self.vector(*c) for c in counts]
        for (at, x), base in zip(vectors, self.common_part(vectors)):
            rows, sims = self.nearest(at, x, base, K) if len(at) and len(base) else (at[:0], x[:0])
            if not len(rows):
                yield self.prior, []
                continue
            value = float(np.interp(self.raw(rows, sims), *self.curve))
            yield value, [{"doc_id": int(self.ids[i]), "toxic": int(self.labels[i]), "cosine": float(c)} for i, c in zip(rows[:3], sims)]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, associated: bool = True) -> tuple[np.ndarray, Index]:
    """The vocabulary (sorted hashes) and the index. associated: terms are weighted by their association with the label, too."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(may_learn()).where("toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found_labels = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().limit(3).collect()}
    if not set(found_labels) <= {0, 1}:
        raise ValueError("toxic must be 0 or 1")
    sample = F.broadcast(bounded_sample(known, "toxic", examples))  # two labels: at most 2 x examples ids
    rows = text_only(docs).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = write_table(rows.mapInArrow(_examples, "doc_id long, toxic int, term array<long>, tf array<int>"), "examples").orderBy("doc_id").toArrow()  # the bounded examples
    ids, y = found["doc_id"].to_numpy(), found["toxic"].to_numpy().astype(np.int64)
    terms, tf = (found[c].combine_chunks() for c in ("term", "tf"))
    cuts = np.append(0, np.cumsum(terms.value_lengths().to_numpy().astype(np.int64)))
    vocabulary, at = np.unique(terms.flatten().to_numpy().view(np.uint64), return_inverse=True)
    df, total = document_frequencies(docs, vocabulary)
    weight = np.log((1 + total) / (1 + df)) + 1
    if associated:
        weight = weight * association(at, np.repeat(y, np.diff(cuts)), int(y.sum()), len(y), len(vocabulary))
    tf = tf.flatten().to_numpy()
    counts = [(at[a:b], tf[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    index = Index(weight, ids, counts, y, found_labels.get(1, 0) / max(1, sum(found_labels.values())))
    del found, terms, tf, counts, at
    index.calibrate({k: n / max(1, int((y == k).sum())) for k, n in found_labels.items()})
    index.vectors = []  # what follows needs the postings alone
    return vocabulary, index


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the three nearest examples) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # the examples' postings, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        for batch in batches:
            for part in slices(batch, 500):
                found = list(index.scores(list(term_counts(part.column("text").to_pylist(), vocabulary))))
                s = np.clip(np.array([a for a, _ in found], float), 0, 1)
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array([e for _, e in found], EVIDENCE)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence"])

    return text_only(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
