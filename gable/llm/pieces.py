"""Operator 4, SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array (prefix doubling up to the longest piece). All pieces of
the vocabulary are looked up by one vectorised binary search, which gives the range of suffixes, so every occurrence,
of each piece. The occurrences are edges between text positions; sorted by end they are relaxed from left to right: each
position keeps the last token of its prefix. For a BPE vocabulary the rule of the relaxation is exact: a prefix's tokens
are those of the shorter prefix and one more piece if, and only if, merging the two last pieces' text alone gives these two pieces
(a boundary that merging never crosses lets both sides evolve alone).

Cases: null and empty texts have no ids and decode to an empty text; characters outside the vocabulary are bytes; a text that
holds the space mark U+2581 itself decodes with a space in its place, as in the library; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, text_only

MARK = "▁"
#: Distinct words whose ids a worker keeps from batch to batch, about; then it begins anew.
CACHE = 400_000
#: Characters of a word whose edges are relaxed for all words of a batch at once.
WAVES = 48
_END = 0x110000  # parts words; no character has this code
_UNIT = re.compile(r" +[^ ]*|[^ ]+")
_models: dict[str, PieceModel] = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them, as far as `depth` codes."""
    rank, h = codes.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        key = rank << 32
        key[:-h] |= rank[h:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        h *= 2
    return order


class PieceModel:
    """A SentencePiece BPE model file (byte fallback, no normalisation, a space before the text)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in own}
        self.score = {self.pieces[i]: sp.get_score(i) for i in own}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = n  # stands for a character without a piece, until it is replaced by its bytes
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a space after another character")
        listed = sorted(own, key=lambda i: self.pieces[i])
        self.depth = max(len(self.pieces[i]) for i in own)
        self.ids = np.array(listed)
        self.lengths = np.array([len(self.pieces[i]) for i in listed])
        self.table = np.zeros((len(listed), self.depth), np.int64)
        for row, i in enumerate(listed):
            self.table[row, : len(self.pieces[i])] = list(map(ord, self.pieces[i]))
        wide = -(-self.depth // 3) * 3
        codes = np.zeros((len(listed), wide), np.int64)
        codes[:, : self.depth] = self.table
        kept = np.where(np.arange(wide) < self.lengths[:, None], (1 << 21) - 1, 0)
        self.packed, self.inside = ((x[:, 0::3] << 42) | (x[:, 1::3] << 21) | x[:, 2::3] for x in (codes, kept))
        self.single = {self.pieces[i] for i in own if len(self.pieces[i]) == 1}
        self.size_of = {i: len(self.pieces[i]) for i in own} | {self.unknown: 1}
        self.as_bytes = [self.pieces[i].replace(MARK, " ").encode() if self.pieces[i] in self.id_of else b"" for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.as_bytes[i] = bytes([b])
        self.fits: dict[int, bool] = {}
        self.slot_keys, self.slot_fits = np.full(1 << 22, -1, np.int64), np.zeros(1 << 22, bool)
        self.cache: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, text: str) -> list[str]:
        """Merging of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, before: int, piece: int) -> bool:
        """Whether `piece` may follow `before` (-1: nothing)."""
        if self.unknown in (before, piece):
            return before < 0 or before == self.unknown or piece == self.unknown or self._fit(-1, piece)
        text = self.pieces[piece]
        return self.merge(text) == [text] if before < 0 else self.merge(self.pieces[before] + text) == [self.pieces[before], text]

    def _known_fit(self, before: int, piece: int) -> bool:
        key = (before + 1) * (self.unknown + 1) + piece
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self._fit(before, piece)
        return ok

    def _all_fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow; answers are kept in a table by a hash of the pair."""
        key = (before + 1) * (self.unknown + 1) + piece
        with np.errstate(over="ignore"):
            slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
        ok = self.slot_fits[slot]
        new = np.nonzero(self.slot_keys[slot] != key)[0]
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            width = self.unknown + 1
            answers = np.array([self._known_fit(k // width - 1, k % width) for k in asked.tolist()], bool)[back]
            ok[new] = answers
            self.slot_keys[slot[new]], self.slot_fits[slot[new]] = key[new], answers
            again = new[self.slot_keys[slot[new]] != key[new]]  # of two pairs in one slot the later stays
            self.slot_keys[slot[again]] = -1
        return ok

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) suffix that begins with each piece, by binary search for all pieces at once."""
        padded = np.append(codes, np.full(self.depth + 3, _END))
        three = (padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:]  # three codes in each number
        at_end = len(order) - 1

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = order[np.minimum(mid, at_end)]
                right = np.full(len(self.ids), after)
                for k in reversed(range(self.packed.shape[1])):  # the first column that differs decides
                    seen = three[np.minimum(at + 3 * k, len(three) - 1)] & self.inside[:, k]
                    right = np.where(seen == self.packed[:, k], right, seen < self.packed[:, k])
                lo = np.where(open_ & right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        return bound(False), bound(True)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and how many each has. A word is what stands between marks, its own marks before it."""
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(sizes + 1) - 1
        codes[stops] = _END
        order = suffix_array(codes, self.depth)
        lo, hi = self.ranges(codes, order)
        n = hi - lo
        take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start, piece = order[take], np.repeat(self.ids, n)
        end = start + np.repeat(self.lengths, n)
        lone = np.ones(len(codes), bool)
        lone[start[end - start == 1]] = False
        lone[stops] = False
        lone = np.nonzero(lone)[0]
        start, end, piece = np.append(start, lone), np.append(end, lone + 1), np.append(piece, np.full(len(lone), self.unknown))
        begins = stops - sizes
        state = np.full(len(codes) + 1, -2, np.int64)  # the last piece of each prefix; -1 at the start of a word
        state[begins] = -1
        reach = end - np.repeat(begins, sizes + 1)[start]  # how far into its word an edge ends
        by = np.argsort(np.minimum(reach, WAVES + 1).astype(np.int16), kind="stable")
        start, end, piece = start[by], end[by], piece[by]
        cuts = np.searchsorted(np.minimum(reach, WAVES + 1)[by], np.arange(WAVES + 3))
        for a, b in zip(cuts[:-2], cuts[1:-1]):  # all words at once, one end position after the other
            if a < b:
                ok = self._all_fit(state[start[a:b]], piece[a:b])
                state[end[a:b][ok]] = piece[a:b][ok]
        last: list[int] = state.tolist()
        rest = np.arange(cuts[-2], len(start))
        rest = rest[np.lexsort((start[rest], end[rest]))]
        for s, e, p in zip(start[rest].tolist(), end[rest].tolist(), piece[rest].tolist()):  # what lies beyond in very long words
            if last[e] == -2 and self._known_fit(last[s], p):
                last[e] = p
        out: list[int] = []
        counts = np.zeros(len(words), np.int64)
        size_of, unknown = self.size_of, self.unknown
        for w, (stop, size) in enumerate(zip(stops.tolist(), sizes.tolist())):
            own: list[int] = []
            e, begin = stop, stop - size
            while e > begin:
                p = last[e]
                if p == unknown:
                    own += [self.bytes[b] for b in reversed(text[e - 1].encode("utf-8", "replace"))]
                else:
                    own.append(p)
                e -= size_of[p]
            out += reversed(own)
            counts[w] = len(own)
        return np.array(out, np.uint16), counts

    def _places(self, words: list[str]) -> np.ndarray:
        """Places in first and count of the words, which are added to the cache where they are new."""
        get = self.cache.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.nonzero(at < 0)[0]
        if len(new):
            fresh = list(dict.fromkeys(words[i] for i in new))
            ids, counts = self.words(fresh)
            base = len(self.first)
            self.first = np.append(self.first, len(self.flat) + np.cumsum(counts) - counts)
            self.count, self.flat = np.append(self.count, counts), np.append(self.flat, ids)
            self.cache.update(zip(fresh, range(base, base + len(fresh))))
            at[new] = [self.cache[words[i]] for i in new]
        return at

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.cache) > CACHE:
            self.cache, self.flat, self.first, self.count = {}, np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = [t or "" for t in texts]
        runs = [i for i, t in enumerate(texts) if "  " in t or t[:1] == " " or t[-1:] == " " or MARK in t]
        odd = set(runs)
        split = pc.split_pattern(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string()), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        distinct = [MARK + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        units = {i: [u.replace(" ", MARK) for u in _UNIT.findall(" " + texts[i].replace(MARK, " "))] for i in runs}
        places = self._places(distinct + [u for i in runs for u in units[i]])
        index = places[: len(distinct)][coded.indices.to_numpy().astype(np.int64)]
        out, at = [], len(distinct)
        for i, t in enumerate(texts):
            if i in odd:
                own = places[at : at + len(units[i])]
                at += len(units[i])
            else:
                own = index[bounds[i] : bounds[i + 1]] if t else index[:0]
            counts = self.count[own]
            ends = np.cumsum(counts)
            out.append(self.flat[np.repeat(self.first[own] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.as_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and round_trip of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, 700):
                texts = part.column("text").to_pylist()
                ids = m.encode(texts)
                back = [m.decode(x) for x in ids]
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
                cols = [
                    part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back], pa.string()), pa.array([a == (b or "") for a, b in zip(back, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return text_only(docs).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
