"""Neighbours, licences and chat formatting against brute force."""

import hashlib
import re

import numpy as np
from gable.llm import ann, chat, licenses
from pyspark.sql import functions as F


def test_neighbours_recall_ties_and_edges(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(int(r["vec_id"]), [float(x) for x in r["embedding"]]) for r in df.collect()]
    extra = [(10_001, None), (10_002, [0.0] * 64), (10_003, [float("nan")] * 64), (10_004, [None] * 64), (10_005, [1.0]), (None, [1.0] * 64), (10_006, rows[1][1]), (10_007, rows[1][1]), (20, rows[20][1])]
    table = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>").withColumns({"list": F.lit(1), "code": F.lit("x"), "v": F.lit(2)})
    found = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, block=100).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    own = [(i, np.array(np.float32(v), float)) for i, v in [*rows, (10_006, rows[1][1]), (10_007, rows[1][1])]]
    ids, x = np.array([i for i, _ in own]), np.stack([v for _, v in own])
    hits = n = 0
    for q, listed in found.items():
        listed.sort()
        s = x @ x[list(ids).index(q)]
        best = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert [r for r, _, _ in listed] == list(range(1, 21)) and q not in [v for _, v, _ in listed]
        assert [(-sc, v) for _, v, sc in listed] == sorted((-sc, v) for _, v, sc in listed)
        assert np.allclose([sc for _, _, sc in listed], [s[list(ids).index(v)] for _, v, _ in listed], atol=1e-12)
        hits, n = hits + len(set(best) & {v for _, v, _ in listed}), n + 20
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    assert hits / n >= 0.9
    assert ann.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORD.findall((text or "").encode().lower())
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_against_brute_force(spark, data, edge_docs, no_docs):
    texts = ["Released under the MIT License. Under the mit-license; CC BY-NC", "cc by nc" * 2, "CC BY nc cc by NC", "apache license, version 2.0", "under under the mit license é", "All rights reserved."]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (own, edge_docs, spark.read.parquet(f"{data}/documents.parquet")):
        expected = sorted([(r["doc_id"], *brute_base(r["text"])) for r in docs.select("doc_id", "text").collect()], key=str)
        out = licenses.scan(docs).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out], key=str) == expected
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in out)
    assert licenses.scan(own).where("labels = 'all-rights-reserved'").count() == 1
    assert licenses.scan(no_docs).count() == 0


def test_span_tolerates_edits(spark):
    template = next(iter(t for t in licenses.TEMPLATES if t.startswith("permission")))
    words = template.split()
    edited = " ".join(words[:6] + ["inserted"] + words[6:12] + words[13:])
    docs = spark.createDataFrame([(1, "x y z " + edited + " tail"), (2, " ".join(reversed(words)))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert out[1]["labels"] == "mit" and 0.6 <= out[1]["score"] < 1
    assert out[2]["labels"] == ""


def test_chat_round_trip_and_edges(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 1, "assistant", "b\\|<\\|n\n"), (2, 5, "assistant", None), (2, None, "sys\ntem", "x"), (3, 0, None, ""), (None, 1, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "score": F.lit("x")})
    formatted = chat.format_conversations(turns)
    own, whole = {}, {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    for r in chat.with_offsets(formatted, chunk=2).orderBy("conv_id", "depth").collect():
        whole.setdefault(r["conv_id"], ["", []])
        assert r["at"] == len(whole[r["conv_id"]][0])
        whole[r["conv_id"]][0] += r["piece"]
        if r["begin"] is not None:
            whole[r["conv_id"]][1].append((r["at"] + r["begin"], r["at"] + r["stop"]))
    assert whole.keys() == own.keys()
    for c, (text, spans) in whole.items():
        turns_back, learned = chat.read_back(text, spans)
        assert turns_back == own[c] and learned == [x for role, x in own[c] if role == "assistant"]
    out = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == len(control) + len("b\\|<\\|n\n")
    assert out[2]["turns_sha256"] == hashlib.sha256(b"sys\ntem\nx\nassistant\n\n").hexdigest()
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0


def test_long_conversation_is_cut(spark):
    """One conversation of most rows, with repeated turns, over several partitions."""
    rows = [(7, i // 2, "assistant" if i % 2 else "user", f"t{i % 5}") for i in range(3000)] + [(8, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    order = sorted((t, r, x) for c, t, r, x in rows if c == 7)
    assert out[7]["n_turns"] == 3000 and out[7]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in order).encode()).hexdigest()
    assert out[7]["loss_sha256"] == hashlib.sha256("".join(x for _, r, x in order if r == "assistant").encode()).hexdigest()
    assert out[8]["n_turns"] == 1


def test_best_branch_of_a_tree(spark):
    """Branches are ranked by the mean score of their path; deep trees need few joins."""
    # means of conversation 1: to leaf 4 1.6/3, to leaf 5 1.7/3; of conversation 4: equal, so the smaller leaf
    nodes = [(1, 1, None, 0.5), (1, 2, 1, 0.9), (1, 3, 1, 0.2), (1, 4, 2, 0.2), (1, 5, 3, 1.0), (2, 100, 999, 0.0), (4, 200, None, 1.0), (4, 202, 200, 0.5), (4, 201, 200, 0.5)]
    nodes += [(3, 1000 + i, 999 + i if i else None, 0.0) for i in range(70)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double")
    path = {}
    for r in chat.chosen_paths(df, branches=2).orderBy("depth").collect():
        path.setdefault((r["conv_id"], r["branch"]), []).append(r["node"])
    assert path == {(1, 1): [1, 3, 5], (1, 2): [1, 2, 4], (2, 1): [100], (3, 1): list(range(1000, 1070)), (4, 1): [200, 201], (4, 2): [200, 202]}
