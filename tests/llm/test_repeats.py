"""Periodic runs, ball k-means codes and the tokenization automaton against brute force and the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from gable.llm import automaton, ballcodes, queries, runs
from tokenizers import Tokenizer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def naive_runs(words, least):
    """Every (start, end, smallest period) by comparing words at each distance."""
    out = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            long = end - start >= max(least, 2 * q)
            if long and not any(all(words[k] == words[k + d] for k in range(start, end - d)) for d in range(1, q)):
                out.add((start, end, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(800):
        codes = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(1, 40))]
        n = len(codes)
        smaller = [next((j for j in range(i + 1, n) if codes[j:] < codes[i:]), n) - i for i in range(n)]
        assert runs.lyndon_array(codes) == smaller
        assert [tuple(x) for x in runs.find_runs(np.array(codes), np.array([0, n]), 2)] == naive_runs(codes, 2)


def test_runs_of_many_texts_in_a_batch():
    r = random.Random(4)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(1, 6)):
            words = []
            while r.random() < 0.8:
                block = [r.choice("abcdefgh") for _ in range(r.randint(1, 9))]
                words += (block * r.randint(1, 5))[: r.randint(3, 40)]
            texts.append(r.choice([" ", "\t \n", "  "]).join(words))
        for text, n, found, collapsed in zip(texts, *(x.to_pylist() for x in runs._detect(pa.array(texts), 12))):
            words = text.split()
            expected = naive_runs(words, 12)
            assert n == len(words) and [(x["start"], x["start"] + x["length"], x["period"]) for x in found] == expected
            assert collapsed == " ".join(w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in expected))


def test_hash_collisions_are_noticed():
    """Thue-Morse words, on which hashes modulo powers of two fail, and Fibonacci words, which have most runs."""
    t, a, b = [0], [0], [0, 1]
    while len(t) < 4096:
        t += [1 - x for x in t]
    while len(b) < 2000:
        a, b = b, b + a
    for codes in (t, b):
        found = runs.find_runs(np.array(codes), np.array([0, len(codes)]))
        assert len(found) and all(codes[s : e - q] == codes[s + q : e] for s, e, q in found.tolist())
    short = b[:300]
    assert [tuple(x) for x in runs.find_runs(np.array(short), np.array([0, 300]))] == naive_runs(short, 12)


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op11_equals_brute_force(spark, tmp_path, data, edge_docs, no_docs):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000").select("doc_id", "text")
    odd = edge_docs.where("doc_id <> 6 and doc_id is not null").selectExpr("doc_id + 100000 doc_id", "text").dropDuplicates(["doc_id"])
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    out = queries.op11_runs(spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    for r in out:
        words = plant(r["doc_id"], [w for w in (texts[r["doc_id"]] or "").encode().split()])
        found = naive_runs(words, 12)
        best = max(found, key=lambda x: (x[1] - x[0], -x[0], -x[2]), default=None)
        expected = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *expected)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in found)]
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
    whole = runs.detect(runs.planted(edge_docs)).collect()
    assert len(whole) == edge_docs.count() and all(r["collapsed"] is not None for r in whole)
    assert runs.detect(no_docs).count() == 0


def naive_codes(v, parts, entries, rounds):
    x = np.floor(256 * np.array(v, float)).astype(np.int64).reshape(len(v), parts, -1)
    books = [x[:entries, m].copy() for m in range(parts)]
    for k in range(rounds + 1):
        d = [((x[:, m, None] - books[m][None]) ** 2).sum(2) for m in range(parts)]
        code = np.stack([c.argmin(1) for c in d], 1)
        if k < rounds:
            books = [np.stack([x[code[:, m] == i, m].sum(0) // (code[:, m] == i).sum() if (code[:, m] == i).any() else b for i, b in enumerate(books[m])]) for m in range(parts)]
    return code, sum(c.min(1) for c in d), np.stack(books)


def test_ball_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-40, 40, (9, 8)) / 64
    v = [(centres[i % 9] + rng.integers(-2, 3, 8) / 256).tolist() for i in range(700)]  # groups, and many ties
    rows = [(i, x, i % 3 if i % 5 else None) for i, x in enumerate(v)]
    bad = [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("inf")] * 8, 1), (1004, [1.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "'clash' x", "'clash' code", "'clash' error").repartition(5)
    coded, books = ballcodes.compress(df, parts=4, entries=16, rounds=3)
    out = sorted(ballcodes.label_errors(coded).collect())
    code, error, expected = naive_codes(v, 4, 16, 3)
    assert (books == expected).all()
    assert [r["vec_id"] for r in out] == list(range(700))
    assert [list(r["code"]) for r in out] == code.tolist() and [r["error"] for r in out] == error.tolist()
    sums = {}
    for (_, _, label), e in zip(rows, error.tolist()):
        sums[label] = sums.get(label, 0) + e
    assert [r["label_error"] for r in out] == [sums[row[2]] for row in rows]


def test_stable_cores_do_no_work():
    """Members in the core of their ball are compared with no other entry, those in rings only with the neighbours up to theirs."""
    balls = ballcodes.Balls(np.array([[[0], [100], [1000]]]))
    balls.surround(np.array([[60, 10, 5]], object))
    assert [n[: (a < ballcodes.FAR).sum()].tolist() for n, a in zip(balls.near[0], balls.apart[0])] == [[1], [], []]
    code, best = balls.again(np.array([[[3]], [[60]], [[50]], [[95]]]), np.array([[0], [0], [0], [1]]))
    assert code.ravel().tolist() == [0, 1, 0, 1] and best.ravel().tolist() == [9, 1600, 2500, 25]
    rng = np.random.default_rng(1)
    for size in (20, 1 << 26):  # products that doubles hold, and that they don't
        x = rng.integers(-size, size, (300, 4, 3))
        balls = ballcodes.Balls(x[:16].swapaxes(0, 1))
        code, best = balls.first(x)
        d = ((x[:, :, None] - balls.entries[None]) ** 2).sum(3)
        assert (code == d.argmin(2)).all() and (best == d.min(2)).all()


def test_ball_codes_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = ballcodes.compress(none)
    assert coded.count() == 0 and books is None
    few = spark.createDataFrame([(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (None, [0.25] * 16, None), (2, [0.0] * 16, None)], none.schema)
    coded, books = ballcodes.compress(few)
    assert books.shape == (16, 3, 1) and coded.count() == 4
    with pytest.raises(ValueError, match="divide"):
        ballcodes.compress(spark.createDataFrame([(1, [0.5] * 15, 1)], none.schema))
    with pytest.raises(ValueError, match="64 bits"):
        ballcodes.compress(spark.createDataFrame([(1, [3e30] * 16, 1)], none.schema))


def naive_bpe(word, merges):
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        pairs = [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]
        if not pairs:
            return word
        _, i = min(pairs)
        word = [*word[:i], word[i] + word[i + 1], *word[i + 2 :]]


def test_automaton_of_random_merges_equals_bpe():
    r = random.Random(8)
    for _ in range(150):
        letters = list("abc")[: r.randint(1, 3)]
        pieces, merges = list(letters), []
        for _ in range(r.randint(0, 14)):
            a, b = r.choice(pieces), r.choice(pieces)
            if a + b not in pieces and len(a + b) < 12:
                merges.append((a, b))
                pieces.append(a + b)
        auto = automaton.Automaton(letters, merges)
        for arc, p in enumerate(auto.pieces):
            auto.spell(arc, p)
        for _ in range(40):
            word = [r.choice(letters) for _ in range(r.randint(0, 30))]
            assert [auto.pieces[i] for i in auto.encode(word)] == naive_bpe(word, merges)
    with pytest.raises(ValueError, match="older pieces"):
        automaton.Automaton(["a"], [("a", "aa"), ("a", "a")])


def test_automaton_equals_library(spark, data):
    library, own = Tokenizer.from_file(WORD_BPE), automaton.encoder(WORD_BPE)
    r = random.Random(1)
    texts = [None, "", "a" * 5000, "Σ ΑΣ ﬁ é \x1c\x1d \x85   <|endoftext|><|startoftext|> x<|endoftext|", "İ I ı ẞ ß", "it's WE'LL 'S 12½ ²", "a\x00b\x7f", "日本 語 ŉ", "e ́", "Å ẛ̣", "don't 'tx 'rex"]
    texts += ["".join(r.choice("abthein'srd lve.,!19 é́ΣŁ<|>\t\x0b") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    texts += [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, own.encode(texts)):
        assert library.encode(text or "", add_special_tokens=False).ids == ids.tolist()
        assert library.decode(ids.tolist(), skip_special_tokens=False) == own.decode(ids)


def test_op13_rows(spark, tmp_path, edge_docs, no_docs):
    library = Tokenizer.from_file(WORD_BPE)
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_automaton(spark, str(tmp_path)).collect()
    expected = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(expected)
    encoded = automaton.encode(edge_docs, WORD_BPE)
    assert automaton.decode(encoded, WORD_BPE).count() == edge_docs.count()
    assert automaton.encode(no_docs, WORD_BPE).count() == 0
