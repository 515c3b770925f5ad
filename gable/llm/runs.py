"""Operator 11, periodic runs of words by Baier grouping.

The first phase of Baier's suffix sorter groups the suffixes of a word sequence from the highest first word down: all members of a
group begin with the same Lyndon word, and the unprocessed place nearest before a member joins that word to its own, as often as members in
a row share the place. When a group is processed, the length of its word is final: it is the longest Lyndon word that begins at each member,
so the phase yields the Lyndon array directly, in linear time and without sorting the suffixes further. It is run under an order of the words and
under the opposite one; every run has a Lyndon root that is an entry of one of the two arrays. Each entry is extended to both sides by
longest common extensions (binary search over prefix hashes; the runs found are compared word by word), and those that reach twice their period are
the runs.

Before that, texts are cut where no run can be. A stretch of at least max(least, 2 * period) words with a period repeats, for each of its words, some window of
least/2 words inside the stretch that holds the word, so words in no repeated window belong to no run; stretches between such words are grouped.
Each text is worked on whole, in the task that holds it; nothing is shuffled.

Cases: a null text has no words; repeated rows and null ids give one row each; a text without runs comes back with its words
joined by one space; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, mix64, text_only

#: Words of the shortest run.
LEAST = 12
#: Moduli of the prefix hashes.
_PRIMES = (2147483647, 2147483629)
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[9:14] = 32


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place (a sequence's own beginnings are smaller than it)."""
    n = len(codes)
    rank = {c: g for g, c in enumerate(sorted(set(codes)))}
    group = [rank[c] for c in codes]
    members: list[list[int]] = [[] for _ in rank]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(rank)  # length of the word that a group's members begin with
    below, above = list(range(-1, len(rank) - 1)), list(range(1, len(rank) + 1))
    # the unprocessed places as a list with two ends; place n stands for both outsides
    left, right = [n, *range(n)], [*range(1, n + 1), 0]
    out = [0] * n
    g = len(rank) - 1
    while g >= 0:
        length = size[g]
        moves: dict[tuple[int, int], list[int]] = {}
        last, times = n, 0
        for i in members[g]:
            if group[i] != g:
                continue  # has moved up
            out[i] = length
            before, behind = left[i], right[i]
            right[before] = behind
            left[behind] = before
            if before == last:
                times += 1
            else:
                if last != n:
                    moves.setdefault((times, group[last]), []).append(last)
                last, times = before, 1
        if last != n:
            moves.setdefault((times, group[last]), []).append(last)
        members[g] = []
        for times, old in sorted(moves, reverse=True):
            moved = moves[times, old]
            new = len(size)
            size.append(size[old] + times * length)
            members.append(moved)
            for i in moved:
                group[i] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up < len(below):
                below[up] = new
        g = below[g]
    return out


class _Extensions:
    """Longest common extensions of places in a sequence of codes, by prefix hashes."""

    def __init__(self, codes: np.ndarray, seed: int):
        n = len(codes)
        rng = np.random.default_rng(seed)
        self.n, self.sums, self.powers = n, [], []
        for p in _PRIMES:
            letter = mix64(codes.astype(np.uint64), seed) % np.uint64(p)
            power = np.ones(n + 1, np.uint64)
            power[1:2] = rng.integers(1 << 20, p - 1)
            have = 2
            while have <= n:
                more = min(have - 1, n + 1 - have)
                power[have : have + more] = power[1 : 1 + more] * power[have - 1] % np.uint64(p)
                have += more
            self.sums.append(np.append(np.uint64(0), np.cumsum(letter * power[:n] % np.uint64(p)) % np.uint64(p)))
            self.powers.append(power)

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the stretches of a length at a and at b (a < b) have one hash."""
        out = np.ones(len(a), bool)
        for p, sums, power in zip(_PRIMES, self.sums, self.powers):
            p = np.uint64(p)
            x, y = ((sums[i + length] + p - sums[i]) % p for i in (a, b))
            out &= x * power[b - a] % p == y
        return out

    def right(self, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
        """How many codes from a on equal those from b on."""
        return self._reach(a, b, longest, 1)

    def left(self, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
        """How many codes before a equal those before b."""
        return self._reach(a, b, longest, -1)

    def _reach(self, a: np.ndarray, b: np.ndarray, longest: int, way: int) -> np.ndarray:
        reach = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(longest).bit_length() - 1)
        while step:
            at, to = (a + reach, b + reach) if way > 0 else (a - reach - step, b - reach - step)
            fits = np.nonzero((to + step <= self.n) & (at >= 0))[0]
            reach[fits[self.same(at[fits], to[fits], step)]] += step
            step >>= 1
        return reach


def _periods_hold(codes: np.ndarray, runs: np.ndarray) -> bool:
    """Whether every run's codes repeat after its period, compared one by one."""
    for i in range(0, len(runs), 4096):
        start, end, period = runs[i : i + 4096].T
        n = end - start - period
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if (codes[at] != codes[at + np.repeat(period, n)]).any():
            return False
    return True


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs (start, end, period) in each stretch bounds[i]:bounds[i+1] of codes, by start, then period. No run leaves its stretch."""
    sizes = np.diff(bounds)
    kept = np.nonzero(sizes >= least)[0]
    if not len(kept):
        return np.zeros((0, 3), np.int64)
    # the kept stretches, each followed by a code of its own
    own = [np.append(codes[bounds[k] : bounds[k + 1]], -1 - i) for i, k in enumerate(kept)]
    shift = np.append(0, np.cumsum([len(x) for x in own]))
    laid, longest = np.concatenate(own), int(sizes[kept].max())
    roots = []
    for sign in (1, -1):
        length = np.concatenate([lyndon_array((sign * x[:-1]).tolist()) + [0] for x in own])
        roots.append(np.stack([np.arange(len(laid)), length], 1)[length > 0])
    roots = np.unique(np.concatenate(roots), axis=0)
    for seed in range(8):
        lce = _Extensions(laid, seed)
        at, period = roots.T
        end = at + period + lce.right(at, at + period, longest)
        start = at - lce.left(at, at + period, longest)
        runs = np.stack([start, end, period], 1)[end - start >= np.maximum(least, 2 * period)]
        runs = np.unique(runs, axis=0)
        if _periods_hold(laid, runs):  # a hash never hides a repeat, so a run that holds is whole
            break
    else:
        raise ArithmeticError("no hash parts these texts")
    where = np.searchsorted(shift, runs[:, 0], "right") - 1
    back = bounds[kept][where] - shift[where]
    runs[:, 0] += back
    runs[:, 1] += back
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(codes: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Bounds of stretches outside of which no run can be; text tells which text a word is in (ascending)."""
    n = len(codes) - window + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    letter = mix64(codes, 7)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + letter[k : k + n]
        key = mix64(key + mix64(text[:n], 11))
    inside = text[:n] == text[window - 1 :]
    slot = (key >> np.uint64(42)).astype(np.int64)  # few windows share a slot by chance; those that do are sorted
    busy = np.nonzero(inside & (np.bincount(slot[inside], minlength=1 << 22)[slot] > 1))[0]
    order = busy[np.argsort(key[busy], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(codes) + 1, np.int32)
    np.add.at(covered, order[again], 1)
    np.add.at(covered, order[again] + window, -1)
    covered = np.cumsum(covered)[:-1] > 0
    edge = np.nonzero((covered[1:] != covered[:-1]) | (text[1:] != text[:-1]))[0] + 1
    bounds = np.concatenate([[0], edge, [len(codes)]])
    return np.stack([bounds[:-1], bounds[1:]], 1)[covered[bounds[:-1]]]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin (one more entry: the end), and all words: what stands between \\x20 and \\x09 to \\x0D."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer(), np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(_SPACES[data]))
    parts = pc.split_pattern(plain, " ")
    at, words = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    real = pc.not_equal(words, "")
    return np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[at], words.filter(real)


def _detect(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Numbers of words, runs and collapsed texts."""
    first, words = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    spans = stretches(codes, text, max(1, least // 2))
    runs = np.zeros((0, 3), np.int64)
    if len(spans):
        own = np.concatenate([np.arange(a, b) for a, b in spans])
        bounds = np.append(0, np.cumsum(spans[:, 1] - spans[:, 0]))
        found = find_runs(codes[own], bounds, least)
        move = spans[:, 0] - bounds[:-1]
        move = move[np.searchsorted(bounds, found[:, 0], "right") - 1]
        runs = found + np.stack([move, move, np.zeros(len(move), np.int64)], 1)
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    keep = np.cumsum(dropped)[:-1] == 0
    left = pa.array(np.append(0, np.cumsum(keep))[first], pa.int32())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(left, words.filter(pa.array(keep))), " ")
    of = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    fields = [pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.array(np.diff(first)), listed, collapsed


def detect(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and collapsed (the text without the repeats of its runs).

    A run is a stretch of at least max(least, 2 * period) words with that smallest period, which no neighbouring word extends. Collapsing
    drops what any run holds after its first period, and joins the words that stay by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i, j in by_bytes([range(n) for n in sizes], 1 << 21):  # ranges stand for the texts' lengths
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *_detect(texts.slice(i, j - i), least)], ["doc_id", "n_words", "runs", "collapsed"])

    return text_only(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, told by the id's checksum, the words from some place on repeat a stretch of the text."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = text_only(docs).select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    own = own.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    a, p = F.col("_a").cast("int"), F.col("_p").cast("int")

    def word(i: Column) -> Column:
        return F.get("_w", F.when(i < a, i).otherwise(a + (i - a) % p))

    return own.select("doc_id", F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise(F.col("text")).alias("text"))
