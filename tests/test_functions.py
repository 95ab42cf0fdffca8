"""Columns against plain Python, on random and edge inputs."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewater.functions import spans, text, tokens
from tidewater.operators.chunking import chunk_grid

TEXTS = ["", " ", "a", " a  b\n", "x\r\ny\tz ", "é😀 b 汉字", "word " * 200, "\n\n", None]


def test_pieces_are_lossless(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    for r in df.select("text", tokens.pieces(F.col("text")).alias("p")).collect():
        assert "".join(r.p) == (r.text or "") and r.p == re.findall("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$", r.text or "")
    offsets = tokens.piece_offsets(df).collect()
    for r in offsets:
        assert len(TEXTS[r.doc_id][: r.char_start].encode()) == r.byte_start


def test_tail_of_nothing_is_nothing(spark):
    row = spark.createDataFrame([("a b c",)], "t string").select(tokens.decode(tokens.tail(tokens.pieces(F.col("t")), F.lit(0))).alias("x"), tokens.decode(tokens.tail(tokens.pieces(F.col("t")), F.lit(9))).alias("y")).first()
    assert (row.x, row.y) == ("", "a b c")


@pytest.mark.parametrize("size,overlap", [(4, 0), (5, 2), (3, 2)])
def test_chunk_grid(spark, size, overlap):
    counts = [0, 1, size, size + 1, 3 * size, 3 * size + 1]
    df = spark.createDataFrame([(i, " ".join("w" * n)) for i, n in enumerate(counts)], "doc_id int, text string")
    got = {}
    for r in chunk_grid(df, size, overlap).orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
    for i, n in enumerate(counts):
        want, start = [], 0
        while n and (not want or want[-1][1] < n):
            want.append((start, min(start + size, n)))
            start += size - overlap
        assert got.get(i, []) == want
    with pytest.raises(ValueError):
        chunk_grid(df, 4, 4)


def union(each):
    out = []
    for s, e in sorted(x for x in each if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_span_unions(spark):
    rng = random.Random(2)
    cases = [[(s := rng.randrange(30), s + rng.randrange(6)) for _ in range(rng.randrange(8))] for _ in range(60)] + [[], [(1, 1)], [(0, 3), (3, 5)], [(0, 9), (2, 4)]]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, x array<struct<s:int,e:int>>")
    for r in df.select("k", spans.merge_array(F.col("x")).alias("m")).collect():
        assert [tuple(v) for v in r.m] == union(cases[r.k])
    rows = spans.merge_rows(df.select("k", F.explode("x").alias("v")).select("k", "v.*"), ["k"]).collect()
    for k, case in enumerate(cases):
        assert sorted((r.s, r.e) for r in rows if r.k == k) == union(case)
    with pytest.raises(Exception, match="reversed"):
        spark.createDataFrame([([(3, 1)],)], "x array<struct<s:int,e:int>>").select(spans.merge_array(F.col("x"))).collect()


def test_covers(spark):
    df = spark.createDataFrame([(0, 3, True), (1, 3, True), (2, 6, False), (4, 4, False), (5, 7, True)], "s int, e int, want boolean")
    merged = F.array(F.struct(F.lit(0).alias("s"), F.lit(3).alias("e")), F.struct(F.lit(5).alias("s"), F.lit(9).alias("e")))
    assert all(r.got == r.want for r in df.withColumn("got", spans.covers(merged, F.col("s"), F.col("e"))).collect())


VALUES = [
    ("$4,870 in thousands", "some 4,870 of them", True), ("$4,870 in thousands", "it was 4870000 dollars", True), ("$4,870", "4,871", False), ("(42)", "-42", True), ("42", "a loss of (42)", True), ("3.50", "3.5", True),
    ("5 million", "5,000,000", True), ("5000000", "about 5 million", True), ("2 billion", "2000 millions", True), ("12%", "12 %", True), ("7", "seven", False), ("5000000", "5 10 million, 2 billion", True), ("5000", "5 10 million, 2 billion", False), ("Acme Holdings Inc", "the ACME group", True), ("Acme Foods", "Acme", False), ("The Company", "the company", False), ("", "x", False), ("x", None, False),
]


def test_value_matches(spark):
    df = spark.createDataFrame(VALUES, "gold string, answer string, want boolean")
    for r in df.withColumn("got", text.value_match(F.col("gold"), F.col("answer"))).collect():
        assert r.got == r.want, r
    assert spark.createDataFrame([("($1,234.50)",)], "t string").select(text.read_number(F.col("t"))).first()[0] == Decimal("-1234.5")


def test_hash_shard_is_the_big_integer(spark):
    import hashlib

    for r in spark.range(50).select("id", text.hash_shard(F.col("id").cast("string"), 13).alias("s")).collect():
        assert r.s == int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16) % 13
