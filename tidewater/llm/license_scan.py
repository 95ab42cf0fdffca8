"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a text join the template positions that have the same k-gram, by hash and then by the words
themselves. A hit at word ``i`` of the text and word ``j`` of a template votes for the diagonal ``i - j``. Votes are added up
by diagonal, neighbouring diagonals (words inserted or left out) merge, and a merged span is verified by the share of the
template's k-grams that it covers and by its extent. A base phrase counts only on a single diagonal that has all its k-grams,
which is where its words stand consecutively.

The template side is a parameter of checked size and is broadcast. Texts are exploded within their task; only hits and one
row per text are shuffled, by row, so a phrase that every text has spreads as the texts do.

Defined cases: a null text counts as empty (0 words, no labels, score 0); rows are told apart by position, so repeated rows
and null ids each give their own row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import ascii_lower

#: Words of a k-gram; diagonals this close merge; least share of a template's k-grams; a span's extent over its template's.
K, NEAR, LEAST_COVER, MOST_EXTENT = 2, 3, 0.7, 1.5
#: Template words that may be broadcast.
MAX_TEMPLATE_WORDS = 200_000

#: Fixed values of the contract: phrases that count where their words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as they are commonly placed in texts, and the method's own labels.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license"],
    "gpl": ["this work is licensed under the gnu general public license", "under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "mpl-2.0": ["subject to the terms of the mozilla public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["licensed under a creative commons attribution", "this work is licensed under cc by"],
    "cc0": ["to the extent possible under law the author has waived all copyright", "dedicated to the public domain"],
    "reserved": ["copyright all rights reserved"],
}


def words(text):
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, from what lies between the other characters."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), "")


def template_grams(spark: SparkSession, base: dict[str, str], templates: dict[str, list[str]], k: int) -> DataFrame:
    rows, total = [], 0
    for n, (phrase, label, is_base) in enumerate([(p, b, True) for p, b in base.items()] + [(p, b, False) for b, ps in templates.items() for p in ps]):
        each = "".join(c if c.isalnum() else " " for c in phrase.lower()).split()
        total += len(each)
        rows += [(n, label, is_base, len(each) - k + 1, j, each[j : j + k]) for j in range(len(each) - k + 1)]
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have {total} words; at most {MAX_TEMPLATE_WORDS} are broadcast")
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, size int, j int, gram array<string>")
    return grams.withColumn("h", F.xxhash64(*[F.col("gram")[x] for x in range(k)]))


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row."""
    grams = template_grams(docs.sparkSession, BASE if base is None else base, TEMPLATES if templates is None else templates, K)
    text = docs.select(F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"), F.monotonically_increasing_id().alias("rid"))
    # place -1 of every text is its own row, so that texts without a hit stay
    places = text.select("rid", "doc_id", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - K, F.lit(-1)))).alias("i"))
    gram = [F.get("w", F.col("i") + x) for x in range(K)]
    rolled = places.withColumn("key", F.when(F.col("i") >= 0, F.xxhash64(*gram)))
    same = F.col("i") < 0
    alike = F.lit(True)
    for x in range(K):
        alike &= gram[x] == F.get("gram", F.lit(x))
    votes = (
        rolled.join(F.broadcast(grams), F.col("key") == F.col("h"), "left")
        .where(same | (F.col("j").isNotNull() & alike))
        .select("rid", "doc_id", F.when(F.col("i") < 0, F.size("w")).alias("n_words"), "template", "label", "base", "size", "j", "i", (F.col("i") - F.col("j")).alias("d"))
        .repartition("rid")
    )
    diagonals = votes.groupBy("rid", "doc_id", "template", "label", "base", "size", "d").agg(
        F.max("n_words").alias("n_words"), F.collect_set("j").alias("js"), F.min("i").alias("first"), F.max("i").alias("last")
    )
    order = Window.partitionBy("rid", "template").orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(order) > NEAR, F.lit(True)) | F.col("base")
    spans = (
        diagonals.withColumn("span", F.sum(apart.cast("int")).over(order))
        .groupBy("rid", "doc_id", "template", "label", "base", "size", "span")
        .agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    cover = F.col("covered") / F.col("size")
    exact = F.col("base") & (F.col("covered") == F.col("size"))
    extent = (F.col("last") - F.col("first") + K) <= (F.col("size") + K - 1) * MOST_EXTENT + NEAR
    found = exact | (~F.col("base") & (cover >= LEAST_COVER) & extent)
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("first"))).cast("long").alias("last_word"),
        names(exact).alias("base_labels"),
        names(found).alias("labels"),
        F.coalesce(F.max(F.when(exact, 1.0).when(~F.col("base") & extent, cover)), F.lit(0.0)).alias("score"),
    ).drop("rid")
