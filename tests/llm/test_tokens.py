"""Packing and pieces against the tokenizer libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from gable.llm import bpe, packing, pieces
from tokenizers import Tokenizer

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b", "  a", "a \n b", "a\n b", "a  ", "a \n", "a\n ", " a", "", "\n \n b", "a   b <|endoftext|> x", "it's 12 34", "x\t y", None, "a\x85 b", "a 　b c", "end ", "don 't 's", " ", "  ", "日本 語 ﬁ", "a\x00b", "▁x y", "😀 é"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_bpe_equals_library(spark, data, tokenizer):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for t, ids in zip(texts, bpe.encoder(BPE).encode_added(texts)):
        assert tokenizer.encode(t or "", add_special_tokens=False).ids == ids.tolist()


def check_packing(docs, found, tokenizer, window=1024):
    """Every id in exactly one piece, sequences gapless and within the window."""
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"], []).append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == ids.keys()
    for doc, texts in ids.items():
        if len(texts) > 1:
            assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(texts[0])
            own = np.array(texts[0][at : at + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(texts[0])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, data, edge_docs, no_docs, tokenizer):
    for docs in (edge_docs, spark.read.parquet(f"{data}/documents.parquet").repartition(5)):
        assert check_packing(docs, packing.pack(docs, BPE).collect(), tokenizer) == 0
    assert packing.pack(no_docs, BPE).count() == 0


def test_solve_never_overdraws():
    rng = np.random.default_rng(5)
    h = np.bincount(rng.integers(0, 64, 4000), minlength=64)
    combos, counts = packing.solve(h, 64)
    used = sum(np.bincount(combos[:, k], weights=counts, minlength=64) for k in range(packing.DEPTH))
    assert (combos.sum(axis=1) == 64).all() and (used[1:] <= h[1:]).all()
    assert used[1:].sum() > 0.9 * h[1:].sum()
    assert len(packing.solve(np.zeros(64, int), 64)[1]) == 0


def test_pieces_equal_library(spark, data, edge_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    model = pieces.model(SP)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for t, ids in zip(texts, model.encode(texts)):
        assert sp.encode(t or "") == ids.tolist()
        assert model.decode(ids) == sp.decode(ids.tolist())
    out = pieces.encode_documents(edge_docs, SP).collect()
    assert len(out) == edge_docs.count() and all(r["round_trip"] for r in out)
    assert pieces.encode_documents(no_docs, SP).count() == 0


def test_suffix_array_is_sorted():
    codes = np.random.default_rng(6).integers(0, 4, 300)
    order = pieces.suffix_array(codes, 16)
    keys = [tuple(codes[i : i + 16]) for i in order]
    assert keys == sorted(keys)
