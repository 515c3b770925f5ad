"""Byte-level BPE ids of whole texts, as the tokenizers library gives them, at the cost of a batch's distinct words.

The pre-tokeniser never joins a character other than white space with a space after it, so a text can be cut before each single
space: the ids of a text are those of its cuts. The distinct cuts of a batch are encoded together, once each, and gathered for
every occurrence by array operations. Texts with runs of spaces are encoded whole. tiktoken does the encoding, from the
vocabulary in the tokenizers file (the ids are the same, in less time). The file's added tokens (`<|endoftext|>`) stand for one id
each wherever a text holds them, unless they are asked to be read as plain text.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words whose ids a worker keeps from batch to batch, about; then it begins anew.
CACHE = 120_000
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space beside other white space, or at the end, isn't a place to cut.
_NO_CUT = f"{_SPACE} | {_SPACE}| $"
#: The byte-level pre-tokeniser's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, BatchEncoder] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or one from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class BatchEncoder:
    """vocabulary: path of a tokenizers file of at most 65,536 ids."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        added = file.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must match exactly where they stand")
        self.added = {t["content"]: t["id"] for t in added}
        # the longest of those that begin at a place
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece) and not piece.startswith("<|")}
        if max([*model["vocab"].values(), *self.added.values()]) >= 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(1 << 16, np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)
        self.cache: dict[str, int] = {}  # place of a word in first and count
        self.ids, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + word for each word, end to end, and how many. No word is empty or begins or ends with white space."""
        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        ids = self.whole(" " + pc.binary_join(one, " ")[0].as_py())
        ends = np.cumsum(self.length[ids])
        cuts = np.searchsorted(ends, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1))
        return ids, np.diff(np.append(-1, cuts))

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of " " + word begin in self.ids, for each word, and how many there are. New words are added to the cache."""
        if len(self.cache) > CACHE:
            self.cache, self.ids, self.first, self.count = {}, np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        listed = words.to_numpy(zero_copy_only=False).tolist()
        get = self.cache.get
        at = np.fromiter((get(w, -1) for w in listed), np.int64, len(listed))
        new = np.nonzero(at < 0)[0]
        if len(new):
            fresh = words.take(pa.array(new))
            odd = pc.match_substring_regex(fresh, f"^{_SPACE}|{_SPACE}$|^$").to_numpy(zero_copy_only=False)
            plain = new[~odd]
            ids, counts = self._together(words.take(pa.array(plain)))
            rest = [self.whole(" " + listed[i]) for i in new[odd]]
            counts = np.concatenate([counts, np.array([len(x) for x in rest], np.int64)])
            order = np.concatenate([plain, new[odd]])
            base = len(self.first)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids, *rest])
            at[order] = base + np.arange(len(order))
            self.cache.update(zip((listed[i] for i in order), range(base, base + len(order))))
        return self.first[at], self.count[at]

    def encode_added(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, its added tokens found: what the library gives for the file as it is."""
        parts = [self.cut.split(t) if self.cut and t and self.cut.search(t) else [t] for t in texts]  # added tokens at odd places
        ids = iter(self.encode([p for part in parts for p in part[::2]]))
        out = []
        for part in parts:
            own = [np.array([self.added[p]], np.uint16) if i % 2 else next(ids) for i, p in enumerate(part)]
            out.append(own[0] if len(own) == 1 else np.concatenate(own))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (unsigned 16-bit) of each text, added tokens read as plain text; null is empty."""
        whole_texts = pa.array([t or "" for t in texts], pa.string())
        no_cut = pc.match_substring_regex(whole_texts, _NO_CUT)
        split = pc.split_pattern(pc.if_else(no_cut, "", whole_texts), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        starts, sizes = self._distinct(coded.dictionary)
        # the first cut of a text has no space before it
        heads = [self.whole(t or "") if w else self.whole((t or "").partition(" ")[0]) for t, w in zip(texts, no_cut.to_pylist())]
        index[at[:-1]] = len(starts) + np.arange(len(texts))
        more = np.array([len(h) for h in heads], np.int64)
        flat = np.concatenate([self.ids, *heads])
        starts = np.concatenate([starts, len(self.ids) + np.cumsum(more) - more])[index]
        counts = np.concatenate([sizes, more])[index]
        ends = np.cumsum(counts)
        take = np.repeat(starts - (ends - counts), counts)
        take += np.arange(len(take))
        out = flat[take]
        bounds = np.append(0, ends)[at]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encoder(vocabulary: str) -> BatchEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = BatchEncoder(vocabulary)
    return _encoders[vocabulary]
