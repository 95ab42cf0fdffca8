import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewater.llm import exact_dedup as E
from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.shared import materialise

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return sorted(((i, max(g := groups[(t or "").translate(LOWER)]), len(g), i == max(g), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in rows), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, kept string")
    return sorted(map(tuple, exact_dedup(docs, **options).collect()), key=str)


ROWS = [(1, None), (2, ""), (3, "Abc É"), (4, "aBC É"), (5, "abc é"), (6, "k"), (7, "K"), (8, "x" * 300 + "A"), (9, "x" * 300 + "a"), (10, "x" * 300 + "b"), (11, "unique"), (12, "eunuqi")]


def test_groups(spark):
    assert run(spark, ROWS, digest_all=True) == run(spark, ROWS, digest_all=True, max_broadcast=0) == brute(ROWS)
    want = run(spark, ROWS)
    assert [r[:4] for r in want] == [r[:4] for r in brute(ROWS)]
    digests = {r[0]: r[4] for r in want}
    assert digests[11] is None and digests[8]  # the full text is read only where length and prefix repeat
    assert run(spark, ROWS, max_broadcast=0) == want  # the same beyond the limit, digests included
    assert run(spark, ROWS, max_broadcast=0, most_bits=8) == want


def test_repeats_reach_the_scan_as_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAST_BITS", 1 << 16)
    keys = materialise(spark.range(3000).selectExpr("CAST(id % 700 AS INT) AS n", "id * 7919 AS p"), "keys")
    rows = spark.range(60_000).selectExpr("CAST(id % 700 AS INT) AS n", "id * 7919 AS p", "id")
    for most, share in ((1 << 27, 0.06), (1 << 16, 0.06), (1 << 12, 1.0)):
        passed = {r.id for r in E.with_repeats(rows, keys, most).where("maybe").collect()}
        assert set(range(3000)) <= passed and len(passed) <= 3000 + share * 57_000


def test_very_long_texts(spark):
    long = "word " * 400_000
    assert [r[:4] for r in run(spark, [(1, long + "A"), (2, long + "a"), (3, long + "b"), (4, None)])] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text("aAbéİ", max_size=4)), max_size=30))
def test_random(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows, digest_all=True) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    got = run(spark, [(1, "a"), (1, "a"), (None, "b"), (2, "b"), (None, "c")])
    assert sum(r[3] for r in got) == 3 and {r[:4] for r in got if r[0] is None} == {(None, 2, 2, False), (None, None, 1, True)}
    assert run(spark, []) == []
