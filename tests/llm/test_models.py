"""Language ID, quality and toxicity: held-out accuracy and defined edge cases."""

import numpy as np
import pytest
from gable.llm import common, langid, quality, toxicity
from pyspark.sql import functions as F

BENCH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BENCH}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BENCH}/labels.parquet")


def test_language_held_out(docs, edge_docs):
    model = langid.train(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all()
    edge = {(r["doc_id"], r["lang_pred"] == "und") for r in langid.identify(edge_docs, model).collect()}
    assert {(0, True), (1, True), (2, True), (8, True), (3, False), (6, False)} <= edge
    assert langid.identify(edge_docs, model).count() == edge_docs.count()


def test_language_without_labels(edge_docs, no_docs):
    model = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.identify(edge_docs, model).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_language_never_reads_held_out_rows(docs):
    model = langid.train(docs)
    other = langid.train(docs.withColumns({"text": F.when(common.held_out(), "xx").otherwise(F.col("text")), "lang": F.when(common.held_out(), "zz").otherwise(F.col("lang"))}))
    assert (model.weights == other.weights).all() and model.temperature == other.temperature


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "b").otherwise("a"))
    one = common.bounded_sample(df, "lang", 500)
    n = {r["lang"]: r["count"] for r in one.groupBy("lang").count().collect()}
    assert n["b"] == 400 and 490 <= n["a"] <= 500
    again = common.bounded_sample(df.union(df).repartition(7), "lang", 500)
    assert one.join(again, "doc_id").count() == again.count() == one.count()
    assert common.bounded_sample(df, "lang", 500, total=20).groupBy("lang").count().where("count > 10").count() == 0
    with pytest.raises(ValueError):
        common.bounded_sample(df, "doc_id", 5)


@pytest.mark.parametrize("repeats", [1_500, 20_000])
def test_sample_of_one_repeated_id(spark, repeats):
    """A class that is one doc_id over and over is one key, and brings one row."""
    df = spark.range(repeats).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the cat and the dog").alias("text"), F.lit("en").alias("lang"))
    df = df.unionByName(spark.createDataFrame([(i, f"der hund und die katze {i}", "de") for i in range(1, 10)], "doc_id long, text string, lang string"))
    assert {r["lang"]: r["count"] for r in common.bounded_sample(df, "lang", 800).groupBy("lang").count().collect()} == {"en": 1, "de": 9}
    model = langid.train(df, F.lit(True))
    assert model.langs == ["de", "en"] and model.predict("the cat and the dog")[0] == "en"


def test_token_hashes_follow_tokens():
    texts = ["Ab, ab  cd", "ab , cd", None, ""]
    cols, owner = quality.gram_buckets(texts)
    assert len(cols) == len(owner) and set(owner) == {0, 1}
    data, _ = common.joined_bytes(["Ab ab %% ab"])
    tokens = common.Tokens(data)
    h = tokens.hashes(tokens.starts, tokens.ends)
    assert h[0] == h[1] == h[3] != h[2] and tokens.word.tolist() == [True, True, False, True]


def test_quality_keeps_good_documents(docs, labels):
    out = quality.resample(docs, labels).join(labels, "doc_id").where(common.held_out()).toPandas()
    assert out.loc[out["quality"] == 1, "selected"].mean() > 0.97
    assert out.loc[out["quality"] == 0, "selected"].mean() < 0.2


@pytest.mark.parametrize("few", [50_000, 3])
def test_quality_top_k_is_exact(spark, few):
    rng = np.random.default_rng(3)
    keys = [float(x) for x in rng.integers(0, 40, 500)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, key double")
    best = set(sorted(range(500), key=lambda i: (-keys[i], i))[:123])
    assert {r["doc_id"] for r in quality.top_k(df, 123, 500, few).where("selected").collect()} == best


def test_quality_draw_is_gumbel_top_k(docs, labels):
    """The draw equals a brute-force one, and isn't the cut at the k-th weight, at the temperature that is fitted."""
    out = quality.resample(docs, labels).withColumn("noise", quality.gumbel()).toPandas()
    (temperature,) = set(out["temperature"])
    assert temperature in quality.TEMPERATURES
    k, key = int(out["selected"].sum()), out["log_weight"] / temperature + out["noise"]
    assert np.allclose(key, out["key"]) and 0 < k < len(out)
    order = np.lexsort((out["doc_id"], -out["key"]))
    assert out["selected"].to_numpy()[order].tolist() == [True] * k + [False] * (len(out) - k)
    cut = np.zeros(len(out), bool)
    cut[np.argsort(-out["log_weight"].to_numpy(), kind="stable")[:k]] = True
    assert (cut != out["selected"]).sum() >= 2
    noise = out["noise"].to_numpy()
    assert abs(noise.mean() - 0.5772) < 0.15 and abs(noise.std() - 1.2825) < 0.15


def test_temperature_is_the_highest_that_keeps_the_good():
    """What is expected to be kept of the good agrees with draws, and falls as the temperature rises."""
    rng = np.random.default_rng(9)
    w, n, good = np.linspace(-1, 1, 41), np.full(41, 50.0), np.r_[np.zeros(20), np.full(21, 5.0)]
    flat, weight = np.repeat(w, 50), np.repeat(good / 50, 50)
    shares = []
    for t in (1.0, 0.3, 0.1, 0.03):
        drawn = [np.argsort(-(flat / t + rng.gumbel(size=len(flat))))[:1000] for _ in range(60)]
        shares.append(quality.expected_kept(w, n, good, 1000, t))
        assert abs(shares[-1] - np.mean([weight[d].sum() for d in drawn]) / good.sum()) < 0.01
    assert shares == sorted(shares) and quality.expected_kept(w, n, good, 2050, 1.0) == 1.0


def test_quality_weights_are_ratios_of_the_models(spark):
    """Ratios and weights of a small table, counted by hand."""
    texts = {1: "good words here", 2: "good words", 3: "bad stuff", 4: "", 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ratio = quality.log_ratio(df, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    grams = {i: quality.gram_buckets([t])[0] for i, t in texts.items()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, cols in grams.items():
        for c in cols:
            raw[c] += 1
            target[c] += i in (1, 2)
    expected = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratio, expected)
    for r in quality.weights(df, ratio).collect():
        cols = grams[r["doc_id"]]
        assert r["n_grams"] == len(cols) and np.isclose(r["log_weight"], expected[cols].sum() / (len(cols) + quality.SHRINK))


def test_quality_edges(edge_docs, no_docs, labels):
    assert quality.resample(edge_docs, labels).count() == edge_docs.count()
    assert quality.resample(no_docs, labels).count() == 0
    out = quality.resample(edge_docs, labels.where("false"))
    assert out.where("selected").count() == edge_docs.count()
    assert quality.keep_selected(edge_docs, labels).columns == edge_docs.columns


def recall_precision(out):
    caught = ((out["predicted"] == 1) & (out["toxic"] == 1)).sum()
    return caught / (out["toxic"] == 1).sum(), caught / max(1, (out["predicted"] == 1).sum())


def test_toxicity_held_out(docs, labels, edge_docs, no_docs):
    out = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    recall, precision = recall_precision(out)
    assert recall >= 0.85 and precision >= 0.95
    assert ((out["score"] >= 0.7) == (out["predicted"] == 1)).all() and out["score"].between(0, 1).all()
    both = docs.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    assert toxicity.score(both, labels).count() == both.count()
    assert toxicity.score(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.score(edge_docs, labels.where("false")).collect()} == {0.0}
    same = toxicity.score(edge_docs, edge_docs.select("doc_id", F.lit(1).alias("toxic"))).where("doc_id = 9").first()
    assert same["score"] > 0.7  # one label only


def test_toxicity_of_few_labels(spark):
    """Some tens of labels that one word tells apart; a rare word of one labelled text; a text that is an example itself."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" zzbad" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    rows.append((500, "qqrare " * 3 + " ".join(rng.choice(words, 5)), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    again = docs.unionByName(spark.createDataFrame([(9000, rows[-1][1], 1), (9001, "", 0), (9002, None, 0)], docs.schema))
    out = toxicity.score(again, docs.select("doc_id", "toxic")).join(again.select("doc_id", "toxic"), "doc_id").toPandas().set_index("doc_id")
    recall, precision = recall_precision(out[out["held_out"] & (out.index < 500)])
    assert recall == 1 and precision == 1 and out["score"].nunique() > 3
    assert out.loc[9001, "score"] == out.loc[9002, "score"] < 0.7
    assert {e["doc_id"] for e in out.loc[9000, "evidence"]} >= ({500} if not out.loc[500, "held_out"] else set())


def test_toxicity_repeated_ids(spark):
    """A labelled doc_id with several rows is one example; every row is scored by its own text."""
    rows = [(1, "zzbad one"), (1, "aa bb"), (3, "good text"), (3, "good text"), (None, "zzbad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 5


def test_terms_are_counted_as_by_hand():
    texts = ["Bad badly, WORSE!! ok\u00a0bad", None, "fine \u00e9t\u00e9s\u00e9", "fine"]
    found = list(toxicity.term_counts(texts))
    # bad, badly, badl*, ",", worse, wors*, "!!", and "ok bad" with its beginning (a no-break space is in the word, as all bytes over 127)
    assert [int(n.sum()) for _, n in found] == [9, 0, 3, 1] and int(found[0][1].max()) == 1
    one, two = (dict(zip(h.tolist(), n.tolist())) for h, n in list(toxicity.term_counts(["idiots idiot", "idiotic"])))
    assert len(one) == 3 and len(two) == 2 and len(one.keys() & two.keys()) == 1  # the beginning alone
    assert max(one.values()) == 2
    vocabulary = np.sort(np.array(list(one), np.uint64))
    (at, tf), (at2, tf2), (at3, _) = toxicity.term_counts(["idiots idiot", "idiotic", None], vocabulary)
    assert sorted(at.tolist()) == [0, 1, 2] and tf.sum() == 4 and len(at2) == 1 and tf2.tolist() == [1] and len(at3) == 0


def brute_index(texts, labels):
    counts = list(toxicity.term_counts(texts))
    vocabulary = np.unique(np.concatenate([h for h, _ in counts]))
    placed = [(np.searchsorted(vocabulary, h), n) for h, n in counts]
    weight = np.log((1 + len(texts)) / (1 + np.bincount(np.concatenate([a for a, _ in placed]), minlength=len(vocabulary)))) + 1
    return toxicity.Index(weight, np.arange(len(texts)), placed, np.array(labels)), placed, len(vocabulary)


@pytest.mark.parametrize("common_share", [0, 3, 10**9])
def test_block_max_search_is_exact(monkeypatch, common_share):
    """Against whole dense vectors, with no, some and all terms as whole columns."""
    monkeypatch.setattr(toxicity, "COMMON", common_share)
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(700)]
    index, placed, size = brute_index([*texts, texts[0], texts[0]], [0] * 702)
    dense = np.zeros((len(index.ids), size))
    for r, (at, x) in enumerate(index.vectors):
        dense[r, at] = x
    assert np.allclose((dense * dense).sum(axis=1), 1)
    vectors = [index.vector(*placed[i]) for i in range(80)]
    for (at, x), base in zip(vectors, index.common_part(vectors)):
        rows, sims = index.nearest(at, x, base, 15)
        whole = dense[:, at] @ x
        best = np.lexsort((index.ids, -np.round(whole, 12)))[:15]
        assert list(rows) == list(best[whole[best] > 0]) and np.allclose(sims, whole[rows])


def test_scores_against_brute_force(spark):
    """Frequencies, weights, votes and curve of a small table, worked out with whole vectors and plain loops."""
    import math
    import re
    from collections import Counter

    rng = np.random.default_rng(9)
    words = [f"w{i}x" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" zz zz" if rng.random() < 0.3 else ""), None) for i in range(90)]
    rows = [(i, t, int("zz" in t and i % 11 > 0)) for i, t, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = {i: Counter(w for w in re.findall(r"\w+", t)) for i, t, _ in rows}  # no word is over four characters long
    learn = {r["doc_id"] for r in docs.where(common.may_learn()).collect()}
    y = {i: t for i, _, t in rows}
    own = sorted(learn)
    df = Counter(w for c in terms.values() for w in c)
    bad, n = sum(y[i] for i in own), len(own)

    def weight(w):
        a = sum(w in terms[i] for i in own if y[i])
        b = sum(w in terms[i] for i in own if not y[i])
        below = (a + b) * (n - a - b) * bad * (n - bad)
        chi = n * (a * (n - bad - b) - b * (bad - a)) ** 2 / below if below else 0.0
        return (math.log((1 + len(rows)) / (1 + df[w])) + 1) * math.sqrt(chi)

    known = {w: weight(w) for w in {w for i in own for w in terms[i]}}

    def vector(i):
        v = {w: (1 + math.log(k)) * known[w] for w, k in terms[i].items() if known.get(w, 0) > 0}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(i) for i in terms}

    def vote(i, among):
        near = sorted(((-round(sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()), 12), j) for j in among))[: toxicity.K]
        near = [(-s, j) for s, j in near if s < 0]
        return sum(s * y[j] for s, j in near) / sum(s for s, _ in near)

    pooled = []
    for s, t in sorted((vote(i, [j for j in own if j != i]), y[i]) for i in own):
        pooled.append([t, 1, s])
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] >= pooled[-1][0] / pooled[-1][1]:
            last = pooled.pop()
            pooled[-1] = [p + q for p, q in zip(pooled[-1], last)]
    xs = [s / m for _, m, s in pooled]
    ys = [(t + 0.5 * bad / n) / (m + 0.5) for t, m, _ in pooled]
    expected = {i: float(np.interp(vote(i, own), xs, np.maximum.accumulate(ys))) for i in terms}
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, docs.select("doc_id", "toxic")).collect()}
    assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-9 for i in found)
