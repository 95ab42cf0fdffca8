import random
import re

from tidewater.llm.license_scan import BASE, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_scan(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, b) for p, b in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in found}))


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, i int")
    return {r.doc_id: r for r in license_scan(docs).collect()}


def test_base_phrases_against_a_loop(spark):
    rng = random.Random(5)
    vocabulary = "cc by general public license all rights reserved All-RIGHTS lo-fi é 7 gnu".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(150)] + [None, "", "   ", "cc", "cc by cc by", "CC-BY", "all\x00rights\x7freserved", "ccé by", "license " * 5000 + "general public license"]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == base_scan(t), t
        assert 0 <= got[i].score <= 1 and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


def test_labels_survive_small_changes_and_scattered_words_do_not(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    got = run(spark, ["foo. Released under the MIT License. bar", mit, mit.replace("free of charge", "entirely free of any charge"), " x ".join(mit.split()), "mit the under license released"])
    assert [got[i].labels for i in range(5)] == ["mit", "mit", "mit", "", ""]
    assert got[0].score == got[1].score == 1 and 0.7 <= got[2].score < 1 and got[4].score < 0.7


def test_edges(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "cc by")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in license_scan(same).collect()) == [(0, 1), (1, 1), (1, 1)]
    plan = license_scan(same)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
