import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import language_id as L

WORDS = {"en": "the and of thing with hand that", "de": "der und nicht ein schön über auch", "fr": "le et de être une déjà où", "es": "el y los niño una está más"}


def docs(spark, n=400, extra=()):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang, "s", 0.5) for i in range(n) for lang in [sorted(WORDS)[i % 4]]]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, score double")


def test_accuracy_on_held_out(spark):
    rows = L.identify(docs(spark)).join(docs(spark).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_is_from_text_alone_and_stable(spark):
    base = docs(spark)
    other = base.withColumn("lang", F.when(L.is_held_out("doc_id"), "de").otherwise(F.col("lang"))).withColumn("source", F.lit("z")).repartition(7)
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in L.identify(x).collect()} for x in (base, other))
    assert one == two


def test_many_unlisted_languages(spark, monkeypatch):
    """Beyond a number of families of their own they are put together by letter, and none is left out."""
    monkeypatch.setattr(L, "OWN_FAMILIES", 3)
    rng = np.random.default_rng(2)
    words = {f"{a}{b}": [f"{a}{b}{k}{c}" for k, c in enumerate("lmnop")] for a in "xyz" for b in "123"}
    rows = [(i, " ".join(rng.choice(words[lang], 10)), lang) for i in range(360) for lang in [sorted(words)[i % 9]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(df).families.names == ["unlisted x", "unlisted y", "unlisted z"]
    held = L.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {r.lang_pred for r in held} == set(words) and sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)


def test_edges(spark):
    extra = [(1001, None, "en", None, None), (1002, "", "de", None, None), (1003, "12 3!² Ⅷ", "fr", None, None), (None, "the and of", None, None, None), (1004, "the " * 200_000, None, None, None), (1005, "ß", None, None, None), (1005, "ß", None, None, None)]
    got = L.identify(docs(spark, extra=extra)).where("doc_id IS NULL OR doc_id > 1000").collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1001, 1002, 1003, 1004)} == {1001: "und", 1002: "und", 1003: "und", 1004: "en"}
    assert len(got) == 7 and all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = docs(spark).limit(0)
    assert L.identify(empty).count() == 0
    assert {r.lang_pred for r in L.identify(docs(spark, 5).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify(docs(spark, 40).withColumn("lang", F.lit("xx"))).collect()} == {"xx"}


def test_given_documents(spark):
    from tidewater.llm.queries import op4_language_id, table

    sf = "/root/testdata/sf0.01"
    rows = op4_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
