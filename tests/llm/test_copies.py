"""Exact and near copies against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from gable.llm import exact_dedup, simhash


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_hash_is_minimal_perfect_and_tells_members():
    words = np.random.default_rng(0).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    levels, slots = exact_dedup.build_mph(words[:4000])
    assert sorted(slots) == list(range(4000))
    assert (exact_dedup.probe_mph(exact_dedup._unpack(exact_dedup._pack(levels)), words[:4000]) == slots).all()
    assert (exact_dedup.probe_mph(levels, words[4000:]) < 4000).all()


def brute_exact(docs):
    own = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    out = []
    for i, t in own:
        same = [j for j, u in own if u == t]
        known = [j for j in same if j is not None]
        out.append((i, max(known) if known else None, len(same), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=str)


def test_exact_against_brute_force(spark, edge_docs, data):
    for docs in (edge_docs, spark.read.parquet(f"{data}/documents.parquet")):
        found = rows(exact_dedup.exact_dedup(docs))
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=str) == brute_exact(docs)
        assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})
        assert {r["member"] for r in found} == {True, False}


def test_exact_of_nothing_and_stage(edge_docs, no_docs):
    assert rows(exact_dedup.exact_dedup(no_docs)) == []
    kept = exact_dedup.keep_distinct(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["text"] or "") for r in kept.collect()) == sorted({r["text"] or "" for r in edge_docs.collect()})


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_masks_cover_every_pair_within_radius():
    masks, rng = simhash.masks(), np.random.default_rng(1)
    assert len(masks) == 31
    for _ in range(3000):
        bits = rng.choice(64, 4, replace=False)
        diff = sum(1 << int(b) for b in bits)
        assert any(m & diff == 0 for m in masks)


@pytest.mark.parametrize("block", [8192, 2])
def test_near_against_brute_force(spark, edge_docs, data, block):
    for docs in (edge_docs, spark.read.parquet(f"{data}/documents.parquet")):
        own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        prints = [brute_fingerprint(t) for _, t in own]
        expected = sorted(zip([i for i, _ in own], [f"{p:016x}" for p in prints], brute_components([i for i, _ in own], prints)), key=str)
        found = sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(docs, block=block))], key=str)
        assert found == expected


def test_dense_and_chained_groups(spark):
    """A chain whose ends are far apart, and a dense group, in buckets of every way of comparing."""
    rng = np.random.default_rng(2)
    chain = [0]
    for i in range(150):
        chain.append(chain[-1] ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    dense = [0x5A5A5A5A5A5A5A5A ^ sum(1 << int(b) for b in rng.choice(64, 2)) for _ in range(200)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in chain + dense})
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    expected = brute_components(prints, [p % (1 << 64) for p in prints])
    for block in (8192, 3):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.class_links(classes, block=block)).collect()}
        assert [roots.get(p, p) for p in prints] == expected


def test_near_of_nothing(no_docs, edge_docs):
    assert rows(simhash.near_duplicates(no_docs)) == []
    assert simhash.keep_one(edge_docs).columns == edge_docs.columns
