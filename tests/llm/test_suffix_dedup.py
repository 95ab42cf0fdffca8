import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.suffix_array import permuted_prefixes, permuted_repeats, suffix_array
from tidewater.llm.suffix_dedup import remove_repeats


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=60), st.integers(1, 3))
def test_suffix_array(text, times):
    data = (text * times).encode()
    assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=80), st.integers(1, 9))
def test_repeats(text, window):
    data = text.encode()
    seen = Counter(data[i : i + window] for i in range(len(data) - window + 1))
    assert permuted_repeats(np.frombuffer(data, np.uint8), window).tolist() == [i + window <= len(data) and seen[data[i : i + window]] > 1 for i in range(len(data))]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 30), st.randoms(use_true_random=False))
def test_prefixes_in_text_order_are_compared_by_bytes(piece, times, most, rng):
    data = piece * times
    before = [rng.choice([-1, *(j for j in (rng.randrange(len(data)), i - len(piece), i - 1) if 0 <= j != i)]) for i in range(len(data))]
    want = [0 if j < 0 else next((n for n in range(most) if max(i, j) + n >= len(data) or data[i + n] != data[j + n]), most) for i, j in enumerate(before)]
    assert permuted_prefixes(np.frombuffer(data, np.uint8), np.array(before), most).tolist() == want


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + window] for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for key, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdeé ", k=500))
    texts = ["".join(rng.choices("abcdefgh ü", k=rng.randrange(900))) for _ in range(25)]
    texts += [x[: rng.randrange(1, len(x) + 1)] + passage[rng.randrange(200) :] + x[:50] for x in texts[:12] if x]
    texts += [texts[3], texts[3], "ab" * 300, "a" * 450, "b" * 199, "b" * 200, "c" * 201, None, "", passage, "x" + passage[:210] * 2]
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [{}, {"shard_texts": 1, "max_broadcast": 0}])
def test_against_brute_force(spark, options):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, kept string, start int")
    assert sorted(map(tuple, remove_repeats(docs, **options).collect()), key=str) == brute(rows, 200)
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, keep_bytes=True, **options).select("doc_id", "kept", "kept_sha256").collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == d for i, *_, d in brute(rows, 200))


def test_edges(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(1, t), (1, t), (2, "other"), (None, t[:250] + "zz"), (None, "q" * 10), (1, "short")]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows, 200)


def test_given_documents(spark):
    from tidewater.llm.queries import op10_suffix_dedup, table

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_suffix_dedup(spark, sf).collect()), key=str) == brute(rows, 200)


def test_rows_without_an_id_of_their_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=256)) for _ in range(3))
    monkeypatch.setattr(F, "hash", lambda *_: F.lit(1))
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    for ids in ((None, None, 5), (7, 7, 5), (-(1 << 63), -(1 << 63), 5), (-3, 7, -3)):
        rows = [(ids[0], a), (ids[1], b), (ids[2], a), (9, c), (None, c[:100])]
        got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        assert got == brute(rows, 200) and [r[2] for r in got].count(256) == 2
