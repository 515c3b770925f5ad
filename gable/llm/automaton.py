"""Operator 13, BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled, in order, into a deterministic automaton that reads pieces: the strings of pieces it accepts are
exactly those that BPE makes. It begins with one state and a loop for every letter. A merge (a, b) adds a gadget: the state that a leads to is
parted, and the new state, which a leads to from then on, lacks the arc b; every state that has an arc a also gets an arc a+b, which leads where b led
from (a merge whose pair the automaton can't read adds nothing). Since a state only ever loses arcs by its gadgets, an arc's presence follows from the chain of gadgets behind the state and from the
pieces that the arc's piece begins with, each as it stood when the next was made; found once, it is put into the transition table. The
automaton has one state for each merge and one more, and each merge's pieces must be older than it (a list of merges that BPE training makes).

A pre-split word is encoded by walking its letters: from each place the arcs of the pieces that are spelled there are tried, the longest first. As the
automaton accepts one string of pieces for every prefix, a place that can be reached is reached in one state only, so a place from which no arc led
on needn't be tried again. The arcs of the path to the word's end are the ids. Decoding emits the labels of the arcs. Normalising and splitting into words follow the vocabulary file: a text is cut at white space, which no word
holds, each distinct cut of a batch is encoded once, and its ids are gathered for every occurrence.

Cases: null is an empty text, an empty text has no ids; added tokens (`<|endoftext|>`) in a text are one id each, as the library reads the file;
repeated rows and null ids give one row each; an empty table gives an empty result; other columns are left out. A word's work grows with its
length times the longest piece's at most.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import byte_letters
from .common import by_bytes, text_only

#: Distinct cuts whose ids, and transitions, that a worker keeps from batch to batch, about; then it begins anew.
CACHE, TRANSITIONS = 200_000, 1_000_000
#: The splitting of lower-case text without white space whose characters are all under 256; other text is left to the library.
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_encoders: dict[str, WordEncoder] = {}


class Automaton:
    """letters: the base pieces. merges: pairs of pieces, in order of rank; each makes the piece that joins the two."""

    def __init__(self, letters: list[str], merges: list[tuple[str, str]]):
        self.pieces = [*letters, *(a + b for a, b in merges)]
        arc = {p: i for i, p in enumerate(letters)}
        base = len(letters)
        self.width = len(self.pieces)
        # of arcs: the piece it begins with, the merge that made it, the state it led to when made, and leads to now
        self.left, self.born, self.entry = [-1] * self.width, [-1] * self.width, [0] * self.width
        self.after = [0] * self.width
        self.owner = [-1] * (len(merges) + 1)  # the arc whose target the gadget of this state parted
        self.gadget: dict[int, int] = {}  # arc a, arc b: the merge whose gadget took arc b from where a leads
        self.dead: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            if a not in arc or b not in arc or a + b in arc:
                raise ValueError(f"merge {rank} ({a} {b}) isn't made of older pieces into a new one")
            x, y, new = arc[a], arc[b], base + rank
            arc[a + b] = new
            if x in self.dead or not self.has_arc(self.after[x], y):
                self.dead.add(new)  # its pair never occurs
                continue
            self.left[new], self.born[new] = x, rank
            self.entry[new] = self.after[new] = self.after[y]
            self.owner[rank + 1] = x
            self.after[x] = rank + 1
            self.gadget[x * self.width + y] = rank
        self.table: dict[int, int] = {}
        self.trie: dict = {}  # by letter the next node; under None (arc, number of letters) of the piece that is spelled so

    def spell(self, arc: int, spelling: Sequence[str]) -> None:
        """Give an arc's spelling in letters."""
        node = self.trie
        for c in spelling:
            node = node.setdefault(c, {})
        node[None] = (arc, len(spelling))

    def has_arc(self, state: int, arc: int) -> bool:
        if arc in self.dead:
            return False
        while state:
            owner, last = self.owner[state], state - 1
            piece, bound = arc, self.width
            while piece >= 0:
                rank = self.gadget.get(owner * self.width + piece)
                if rank is not None and rank <= last and rank <= bound:
                    return False
                bound, piece = self.born[piece], self.left[piece]
            state = self.entry[owner]
        return True

    def step(self, state: int, arc: int) -> int:
        """Where an arc leads from a state, -1 if the state lacks it."""
        key = state * self.width + arc
        to = self.table.get(key)
        if to is None:
            to = self.table[key] = self.after[arc] if self.has_arc(state, arc) else -1
        return to

    def encode(self, letters: list[str]) -> list[int]:
        """The arcs of the only path over these letters: the longest piece first, and back from where no piece goes on."""
        n, width, table, trie = len(letters), self.width, self.table, self.trie
        out: list[int] = []
        tried: list[tuple[int, int, list]] = []  # places on the path, their states, and the pieces that are left to try
        dead: set[int] = set()  # no path goes on from these
        at = state = 0
        while at < n:
            node, pieces = trie, []
            for j in range(at, n):
                node = node.get(letters[j])
                if node is None:
                    break
                piece = node.get(None)
                if piece is not None:
                    pieces.append(piece)
            while True:
                while pieces:
                    arc, size = pieces.pop()
                    if at + size in dead:
                        continue
                    to = table.get(state * width + arc)
                    if to is None:
                        to = self.step(state, arc)
                    if to >= 0:
                        break
                else:
                    dead.add(at)
                    if not tried:
                        raise ValueError("a letter that the vocabulary lacks")
                    at, state, pieces = tried.pop()
                    out.pop()
                    continue
                tried.append((at, state, pieces))
                out.append(arc)
                at, state = at + size, to
                break
        return out


class WordEncoder:
    """vocabulary: path of a tokenizers file with word ends, byte letters and no prefix, whose splitting keeps white space out of words."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.suffix = model["end_of_word_suffix"]
        added = file.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must match exactly where they stand")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        letters = byte_letters()
        base = [p for c in letters for p in (c, c + self.suffix) if p in model["vocab"] and p not in made]
        self.automaton = Automaton(base, merges)
        for arc, piece in enumerate(self.automaton.pieces):
            spelling = list(piece.removesuffix(self.suffix))
            if piece.endswith(self.suffix):
                spelling[-1] += self.suffix  # a letter at a word's end is another letter
            self.automaton.spell(arc, spelling)
        self.letter = {b: c for c, b in letters.items()}
        self.ids = np.array([model["vocab"][p] for p in self.automaton.pieces], np.uint32)
        self.labels = {i: p.encode() for p, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        library = Tokenizer.from_file(vocabulary)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.cache: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words: dict[str, list[int]] = {}

    def _split(self, cut: str) -> list[str]:
        """The words of a stretch without white space, in byte letters."""
        if cut.isprintable():
            if cut.isascii():
                return _LATIN_WORDS.findall(cut.lower())
            if max(cut) < "\u0100":
                return ["".join(map(self.letter.__getitem__, w.encode())) for w in _LATIN_WORDS.findall(cut.lower())]
        text = self.normalizer.normalize_str(cut) if self.normalizer else cut
        return [w for w, _ in self.splitter.pre_tokenize_str(text)]

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            letters = list(word)
            letters[-1] += self.suffix
            ids = self.words[word] = self.ids[self.automaton.encode(letters)].tolist()
        return ids

    def _places(self, cuts: list[str]) -> np.ndarray:
        """Where each distinct cut stands in first and count; new ones are encoded."""
        if len(self.automaton.table) > TRANSITIONS:
            self.automaton.table = {}
        if len(self.cache) > CACHE:
            self.cache, self.words = {}, {}
            self.flat, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        get = self.cache.get
        at = np.fromiter((get(c, -1) for c in cuts), np.int64, len(cuts))
        new = np.nonzero(at < 0)[0].tolist()
        ids: list[int] = []
        counts = np.zeros(len(new), np.int64)
        for k, i in enumerate(new):
            before = len(ids)
            for w in self._split(cuts[i]):
                ids += self._word(w)
            counts[k] = len(ids) - before
        base = len(self.first)
        self.first = np.append(self.first, len(self.flat) + np.cumsum(counts) - counts)
        self.count, self.flat = np.append(self.count, counts), np.append(self.flat, np.array(ids, np.uint32))
        self.cache.update(zip((cuts[i] for i in new), range(base, base + len(new))))
        at[new] = base + np.arange(len(new))
        return at

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without added tokens."""
        split = pc.split_pattern_regex(pa.array(texts, pa.string()), "[ \t-\r]+")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())
        index = places[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        counts = self.count[index]
        ends = np.cumsum(counts)
        take = np.repeat(self.first[index] - (ends - counts), counts)
        take += np.arange(len(take))
        flat, at = self.flat[take], np.append(0, ends)[bounds]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each text; null is empty."""
        parts = [self.cut.split(t) if self.cut and t and self.cut.search(t) else [t or ""] for t in texts]  # added tokens at odd places
        ids = iter(self._encode([p for part in parts for p in part[::2]]))
        out = []
        for part in parts:
            own = [np.array([self.added[p]], np.uint32) if i % 2 else next(ids) for i, p in enumerate(part)]
            out.append(own[0] if len(own) == 1 else np.concatenate(own))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs with a space between, as the library gives for a file without a decoder."""
        return b" ".join(map(self.labels.__getitem__, ids.tolist())).decode()


def encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers end to end) of every whole text."""
    return _run(docs, vocabulary, False)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """What encode gives, and `decoded`, the text that the ids are decoded to."""
    return _run(docs, vocabulary, True)


def _run(docs: DataFrame, vocabulary: str, back: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in by_bytes(texts, 1 << 20):
                ids = own.encode(texts[i:j])
                cols = [batch.column("doc_id").slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if back:
                    cols.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    return text_only(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", decoded string" if back else ""))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and decoded of rows as encode gives them; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            back = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
