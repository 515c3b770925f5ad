import pytest

LONG = " ".join(f"w{i % 977} lorem ipsum" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with the operators' own."""
    texts = [None, "", "   \n\t", "One two three four five.", "One two three four five.", "été été 😀 ok", LONG, "a", "12 34 %%%", "the cat sat on the mat and the dog", "der Hund und die Katze sind im Haus"]
    rows = [(i, t, "en" if i % 2 else "de", None if i == 3 else "s", 7) for i, t in enumerate(texts)]
    rows += [(4, texts[4], None, "s", 7), (None, "One two three four five.", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("uid", "fp", "score", "part", "n", "rest", "rank", "digest", "label", "held_out", "key", "good", "toxic", "ids", "hits", "shard"):
        df = df.withColumn(c, df["source"])
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
