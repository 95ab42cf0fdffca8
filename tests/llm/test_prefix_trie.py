import hashlib
import random
import re
import zlib

import pytest

from tidewater.llm.prefix_trie import end_digests, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", told(role or "", text or ""), text or ""))
    convs = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def told(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * words
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in prefix_trie(table, **options).select(*COLUMNS).collect()), key=str)


def corpus(seed, ids=range(-45, 130)):
    draw = random.Random(seed)
    rows = []
    for c in ids:
        if draw.random() < 0.15:
            continue
        for t in range(draw.choice([1, 1, 2, 3, 5, 9])):
            text = draw.choice(["a b", "a b", "a  b\tc", "é\x0bx y", "", None])
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("most", [200_000, 3])
def test_equals_loops(spark, most):
    rows = corpus(1)
    assert run(spark, rows, most=most) == brute(rows)


def test_copies_over_families(spark):
    talk = [(t, "user" if t % 2 else "assistant", f"turn {t} of it") for t in range(23)]
    rows = [(c, *t) for c in (0, 20, 41, 60, 61, 200, -20) for t in talk] + [(c, *t) for c in (80, 100) for t in talk[:7]] + [(120, 0, "system", "alone")]
    for most in (200_000, 5):
        assert run(spark, rows, most=most) == brute(rows)


def test_odd_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "a")]) == []
    rows = [(7, None, None, None), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, "assistant", "x"), (9, 0, "a", "bc"), (29, 0, "ab", "c"), (5, 0, "user", "word " * 50_000)]
    assert run(spark, rows) == brute(rows)
    lone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][0]
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]  # no base, and both turns are replaced
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_ends_of_one_node_lie_in_many_packs(spark):
    ids = [*range(-300, 3000, 3)]
    table = spark.createDataFrame([(b"k", c) for c in ids] + [(b"l", 5)], "key binary, conv_id long").repartition(5)
    want = {"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "l": hashlib.sha256(b"5").hexdigest()}
    assert {bytes(r.key).decode(): r.ends_sha256 for r in end_digests(table, 7).collect()} == want
