import hashlib
import math

import numpy as np
import pytest

from tidewater.llm import vector_codes as V
from tidewater.llm.vector_codes import Codebook, compress

SCHEMA = "vec_id long, embedding array<double>, label string, code int, id string"


def brute(rows, parts=4, entries=256, rounds=4):
    """The contract by loops over Python integers."""
    good = [(i, [math.floor(1024 * x) for x in v], w) for i, v, w in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in good]
    n = max(lengths, key=lambda x: (lengths.count(x), x))
    good = [r for r in good if len(r[1]) == n]
    at = V.cuts(n, parts)
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[a:b] for _, v, _ in first] for a, b in zip(at, at[1:])]
    apart = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q))
    near = lambda k, v: min((apart(v[at[k] : at[k + 1]], e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            members = {}
            for _, v, _ in good:
                members.setdefault(near(k, v)[1], []).append(v[at[k] : at[k + 1]])
            new.append([[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(books[k])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, "".join(f"{near(k, v)[1]:02x}" for k in range(parts)), sum(near(k, v)[0] for k in range(parts)), w) for i, v, w in good]
    totals = {}
    for _, _, e, w in found:
        totals[w] = totals.get(w, 0) + e
    return sorted(((i, c, e, w, totals[w], digest) for i, c, e, w in found), key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in compress(table, **options).collect()), key=str)


def vectors(n, d, seed=0):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(0, 0.2, d).round(6).tolist(), "abc"[i % 3]) for i in range(n)]


def test_equals_loops(spark):
    rows = vectors(330, 8)
    assert run(spark, rows) == brute(rows)


def test_few_entries_ties_and_repeats(spark):
    rows = [(i, [(i * 7 % 5) / 4, 0.25, -0.1, (i % 3) / 2, 1.0, -1.0, 0.5, (i % 2) * 0.5], None if i % 4 else "a") for i in range(60)]
    rows += rows[:9] + [(None, rows[3][1], "a")]
    for entries in (1, 5, 256):
        assert run(spark, rows, entries=entries, rounds=2) == brute(rows, entries=entries, rounds=2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, "a"), (901, [0.1, None, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], "a"), (902, [nan] * 8, None), (-5, [inf] * 8, "b"), (-6, [], "b"), (903, [1.0], "b"), (-7, [-0.5] * 8, None)]
    rows = vectors(40, 8) + odd
    assert run(spark, rows) == brute(rows)
    assert {r[0] for r in run(spark, rows)} == {*range(40), -7}
    assert run(spark, []) == [] and run(spark, [(1, None, "a")]) == []
    assert run(spark, [(1, [], "a"), (2, [], None)]) == brute([(1, [], "a"), (2, [], None)])
    uneven = vectors(30, 10, 3)  # 3, 3, 2 and 2 components
    assert run(spark, uneven, entries=4) == brute(uneven, entries=4)


def test_components_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30] * 8, "a"), (2, [0.0] * 8, "a")])


@pytest.mark.parametrize("scale", [30, 400, 3_000_000])
def test_partial_distances_find_the_nearest_entry(scale):
    draw = np.random.default_rng(scale)
    book = draw.integers(-scale, scale, (200, 12))
    x = np.concatenate([draw.integers(-scale, scale, (500, 12)), book[:50], (book[:50] + book[50:100]) // 2])
    index, error = Codebook(book).nearest(x)
    full = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (error == full.min(1)).all()
