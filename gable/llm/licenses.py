"""Operator 8, license scans by diagonal voting.

Words of a text (ASCII letters and digits after lower-casing, and anything beyond ASCII) are numbered by the templates' vocabulary; a k-gram
of numbers is an exact rolling hash of its words. Every text's k-grams of known words are joined in Spark with the template
positions of the same k-gram. Hits are counted by diagonal (position in the text less position in the template);
hits on neighbouring diagonals of one template make a chain, which tolerates some inserted or missing words. Read in order of
the text, a chain is parted into spans where the template begins again, so repeats in succession are spans of their own; a span is kept
if its hits stand for enough different positions of the template. The base phrases are templates of their own that must match in full on one diagonal.

Cases: null and empty text have no words; repeated rows are scanned each on their own; an empty table gives an empty result. Texts
have no length limit: a text's k-grams are rows, not one group. A notice with more than DRIFT foreign words at one place is two spans there, and is
lost to the method if neither covers COVER of its template; base phrases aren't affected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_only, write_table

K = 3
#: Diagonals this far apart at most belong to one span: words inserted or left out.
DRIFT = 3
#: Share of a template's k-grams that a span must cover.
COVER = 0.6
# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Short notices and opening passages of public licenses, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "all rights reserved": "all-rights-reserved",
}

# Bytes that part words are turned into spaces, A to Z into lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def template_rows() -> tuple[dict[bytes, int], list[tuple[int, int, str, bool, int, int]]]:
    """The vocabulary (numbers from 1), and (k-gram, template, label, is it a base phrase, position, number of k-grams) of every template position."""
    vocabulary: dict[bytes, int] = {}
    rows = []
    for template, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        n = len(ids) - K + 1
        rows += [((ids[i], ids[i + 1], ids[i + 2]), template, label, template < len(PHRASES), i, n) for i in range(n)]
    size = len(vocabulary) + 1
    return vocabulary, [((a * size + b) * size + c, *rest) for (a, b, c), *rest in rows]


def _scan(vocabulary: dict[bytes, int], grams: np.ndarray):
    size = len(vocabulary) + 1
    gram_type = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            for part in slices(batch, 500):
                counts, hits = [], []
                for text in part.column("text").to_pylist():
                    found = words(text)
                    counts.append(len(found))
                    ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
                    at = np.nonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))[0] if len(ids) >= K else np.zeros(0, np.int64)
                    gram = (ids[at] * size + ids[at + 1]) * size + ids[at + 2] if len(at) else at
                    known = np.isin(gram, grams)  # what the join would drop needn't leave the task
                    hits.append([{"pos": int(p), "gram": int(g)} for p, g in zip(at[known], gram[known])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, gram_type)], ["doc_id", "n_words", "hits"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans and spans (first and last word, label, cover) of every document."""
    spark = docs.sparkSession
    vocabulary, rows = template_rows()
    templates = spark.createDataFrame(rows, "gram long, template int, label string, base boolean, tpos int, n int")  # as large as the templates
    grams = np.unique(np.array([r[0] for r in rows]))
    scanned = text_only(docs).mapInArrow(_scan(vocabulary, grams), "doc_id long, n_words long, hits array<struct<pos:long,gram:long>>")
    scanned = write_table(scanned.withColumn("uid", F.monotonically_increasing_id()), "grams")
    hits = scanned.select("uid", F.explode("hits").alias("h")).select("uid", F.col("h.pos").alias("pos"), F.col("h.gram").alias("gram"))
    votes = hits.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    diagonals = votes.groupBy("uid", "template", "label", "base", "n", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    base = diagonals.where("base and votes = n").select("uid", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n") + (K - 2)).alias("last"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    chains = diagonals.where("not base").select("uid", "template", "diagonal", F.coalesce(far, F.lit(True)).cast("int").alias("start")).withColumn("chain", F.sum("start").over(to_here)).drop("start")
    own = votes.where("not base").join(chains, ["uid", "template", "diagonal"])
    # hits in order of the text: a new span where the diagonal moves by the template's length, or goes back in the template by more than edits do
    read = Window.partitionBy("uid", "template", "chain").orderBy("pos", "tpos")
    moved = F.col("diagonal") - F.lag("diagonal").over(read)
    again = (moved >= F.col("n") + K - 1) | ((moved > DRIFT) & (F.col("tpos") <= F.lag("tpos").over(read)))
    own = own.withColumn("again", F.coalesce(again, F.lit(True)).cast("int")).withColumn("run", F.sum("again").over(read.rowsBetween(Window.unboundedPreceding, 0)))
    # or where it is back at the span's first position
    inside = Window.partitionBy("uid", "template", "chain", "run").orderBy("pos", "tpos")
    back = F.col("tpos") <= F.min("tpos").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("back", F.coalesce(back, F.lit(True)).cast("int")).withColumn("span", F.sum("back").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spans = own.groupBy("uid", "template", "label", "n", "chain", "run", "span").agg(F.countDistinct("tpos").alias("covered"), F.min("pos").alias("first"), (F.max("pos") + K - 1).alias("last"))
    spans = spans.withColumn("cover", F.col("covered") / F.col("n")).where(F.col("cover") >= COVER)
    found = base.unionByName(spans.select("uid", "label", F.lit(False).alias("base"), "first", "last", "cover"))
    by_doc = found.groupBy("uid").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"), F.count("*").alias("n_spans"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "cover"))).alias("spans"),
    )
    return scanned.select("uid", "doc_id", "n_words").join(by_doc, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint,label:string,cover:double>>")).alias("spans"),
    )
