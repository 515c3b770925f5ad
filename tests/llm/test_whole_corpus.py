"""Corpus operators on planted cases that a bounded list of candidates, a bounded span or a bounded vocabulary would lose."""

from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from gable.llm import ann, bpe, common, langid, licenses, packing
from pyspark.sql import functions as F
from test_tokens import ODD, check_packing
from tokenizers import Tokenizer


def brute_nearest(x, q, k=20):
    s = x @ x[q]
    return [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


def test_neighbours_among_thousands_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODEWORDS", 16)  # coarse codes stand for the coarse codes of a large table
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[2000:3500] = x[2000] + rng.normal(size=(1500, 64)) * 0.0005
    x[3500:] = x[3500]  # exact copies: ties by id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, block=1500).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = [len(set(found[q]) & set(brute_nearest(x, q))) / 20 for q in range(0, 4000, 100)]
    assert np.mean(hits[20:35]) > 0.99 and np.mean(hits[:20]) >= 0.9
    assert found[3600] == list(range(3500, 3520))


def test_clustered_vectors_need_few_lists_and_hot_shards_are_copied(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 32)) * 4
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32)) * 0.1
    codes = ann.fit(x, 77)
    assert ann.lists_to_visit(codes, x, 20, 0.97) <= 12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, block=400, queries=7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert np.mean([len(set(found[q]) & set(brute_nearest(x, q))) / 20 for q in range(0, 6000, 50)]) >= 0.9


def test_neighbours_beyond_the_sample(spark):
    """More vectors than centroids and codebooks are fitted on: recall over all of them, scores exact."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(300, 16)) * 3
    x = centres[rng.integers(0, 300, 2 * ann.SAMPLE)] + rng.normal(size=(2 * ann.SAMPLE, 16)) * 0.3
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    found = {}
    for r in ann.search(df, F.col("vec_id") % 200 == 0).orderBy("query_id", "rank").collect():
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found.keys() == set(range(0, len(x), 200))
    hits = np.array([len(set(found[q]) & set(brute_nearest(x, q))) / 20 for q in found])
    assert hits.mean() >= 0.95 and np.quantile(hits, 0.05) >= 0.6


def test_long_vectors_make_small_shards_and_written_tables_can_be_removed(spark, monkeypatch):
    """Bounds in bytes instead of vectors find the same neighbours; afterwards nothing that was written is left."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 64))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "gable"
    common.remove_tables(spark)
    before = set(folder.glob("*")) if folder.exists() else set()
    monkeypatch.setattr(ann, "BYTES", 64 * 8 * 50)  # 50 vectors
    monkeypatch.setattr(ann, "TRIALS", 50)
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert np.mean([len(set(found[q]) & set(brute_nearest(x, q))) / 20 for q in range(0, 600, 20)]) >= 0.9
    written = set(folder.glob("*")) - before
    assert len(written) == common.remove_tables(spark) > 0 and set(folder.glob("*")) == before
    assert common.remove_tables(spark) == 0


def test_language_stage_keeps_texts_when_no_language_is_known(spark):
    texts = [None, "", " 12 %", "One two.", "été", "x"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [3, 4, 5]
    assert langid.keep_told(docs.where("false"), langid.train(docs)).count() == 0


def test_repeats_of_a_template_are_spans_of_their_own(spark):
    template = next(t for t in licenses.TEMPLATES if t.startswith("permission"))
    w = template.split()
    texts = [
        "all rights reserved " * 5,
        " ".join(w[:3] * 12 + w),  # the beginning stutters
        " ".join([*w[:9], *w[6:9] * 20, *w[9:]]),  # the middle stutters
        " ".join([*w[:6], "x", "y", *w[6:], *w[1:8], "z", *w[8:]]),
        " ".join(w[3:6] * 12),  # a few positions many times
    ]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[0]["spans"]] == [(3 * i, 3 * i + 2, "all-rights-reserved", 1.0) for i in range(5)] and out[0]["n_spans"] == 5
    assert [tuple(s) for s in out[1]["spans"]] == [(36, 35 + len(w), "mit", 1.0)]
    assert out[2]["labels"] == "mit" and out[2]["n_spans"] == 1
    assert [s["first"] for s in out[3]["spans"]] == [0, len(w) + 2]
    assert out[4]["labels"] == "" and out[4]["spans"] == []


def test_packing_finds_added_tokens_as_the_library_does(spark):
    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    library = Tokenizer.from_file(path)
    texts = [f"a {end} b", end, end * 3, f"{end}x", f" x{end} ", f"a  {end}\n b", "<|endoftext", f"<|{end}|>", f"the end {end}" * 400, *ODD]
    for t, ids in zip(texts, bpe.encoder(path).encode_added(texts)):
        assert library.encode(t or "", add_special_tokens=False).ids == ids.tolist()
    assert bpe.encoder(path).encode_added(texts[:1])[0].tolist() == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check_packing(docs, packing.pack(docs, path).collect(), library) == 0
