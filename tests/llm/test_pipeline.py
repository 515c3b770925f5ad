"""The pipeline's stages, each against a brute-force version."""

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from test_copies import brute_components, brute_fingerprint
from test_tokens import check_packing
from tokenizers import Tokenizer


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    (_, language), (_, quality), (_, exact), (_, near), (_, packed) = corpus_pipeline.STAGES
    told = language(spark, docs, data)
    assert ids(told) == sorted(r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    good = quality(spark, told, data).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = set(ids(good))
    assert sum(labels[i] == 1 for i in labels if i in kept) >= 0.97 * sum(labels.values())
    assert sum(labels[i] == 0 for i in labels if i in kept) <= 0.3 * sum(1 - q for q in labels.values())
    once = exact(spark, good, data).cache()
    last = {}
    for r in good.collect():
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert ids(once) == sorted(last.values())
    one = near(spark, once, data).cache()
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert ids(one) == sorted(set(brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])))
    for out in (told, good, once, one):
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert check_packing(one, packed(spark, one, data).collect(), tokenizer) == 0


def test_stages_go_by_row(spark, edge_docs, tmp_path):
    """Nulls, repeated ids of good and bad texts, repeated rows and clashing columns through every stage."""
    junk = "%% %% %% ## ## " * 40
    more = spark.createDataFrame([(4, "", "de", "s", 7), (None, junk, None, None, None), (None, "", None, None, None), (-1, "One two three four five.", "en", "s", 7), (9, "12 %%", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in edge_docs.columns[5:]:
        more = more.withColumn(c, more["source"])
    docs = edge_docs.unionByName(more)
    (_, language), (_, quality), (_, exact), (_, near), (_, packed) = corpus_pipeline.STAGES

    def rows(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)

    told = language(spark, docs, "").cache()
    assert rows(told) == [r for r in rows(docs) if any(c.isalpha() for c in r[1] or "")]
    labels = spark.createDataFrame([(i, int(i != 7), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = quality(spark, told, str(tmp_path)).cache()
    assert good.columns == docs.columns and good.exceptAll(told).count() == 0 and good.count() > 0
    once = exact(spark, docs, "").cache()
    best = {}
    for i, t in rows(docs):
        best[t or ""] = max(best.get(t or "", -(1 << 62)), -(1 << 61) if i is None else i)
    assert sorted((t or "", -(1 << 61) if i is None else i) for i, t in rows(once)) == sorted(best.items())
    one = near(spark, docs, "").cache()
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for i, (_, root) in enumerate(zip(own, brute_components(list(range(len(own))), [brute_fingerprint(t) for _, t in own]))):
        groups.setdefault(root, []).append(own[i])
    kept = rows(one)
    assert len(kept) == len(groups) and one.exceptAll(docs).count() == 0
    firsts = sorted((min(i for i, _ in g if i is not None) if any(i is not None for i, _ in g) else None for g in groups.values()), key=str)
    assert sorted((i for i, _ in kept), key=str) == firsts
    assert packed(spark, docs, "").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_of_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
