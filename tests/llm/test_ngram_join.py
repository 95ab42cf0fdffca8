import random

import numpy as np
import pytest
from pyspark import cloudpickle

from tidewater.llm import ngram_join as N
from tidewater.llm import part_enum as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, rep int, component_id string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.similar_components(docs, **options).collect()}


def corpus(seed):
    """Clusters of near copies whose members differ more and more, shared passages, tiny and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([7, 12, 30, 80, 400]))]
        for _ in range(rng.choice([2, 5, 16])):
            base = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    texts += [" ".join([word() for _ in range(rng.randrange(40))] + passage) for _ in range(25)]
    texts += [None, "", "  \t", "one", "ONE", "one two", "a b c d e", "A b c d e", "a b c d e f", texts[0].upper(), texts[0], texts[1].replace(" ", "\n")]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed, monkeypatch):
    rows = corpus(seed)
    want = brute(rows)
    assert run(spark, rows) == want
    if seed == 1:  # every run is long, so that rounds and blocks have work; and nothing may be broadcast
        monkeypatch.setattr(N, "SHORT", 1)
        monkeypatch.setattr(N, "BLOCK_SHINGLES", 300)
        assert run(spark, rows, max_broadcast=0) == want


def signed(sets):
    sigs, whose, needed = P.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    return [set(sigs[whose == k].tolist()) for k in range(len(sets))], needed


def test_similar_sets_share_the_signatures_that_they_need(rounds=400):
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        size = int(rng.integers(3, 3000)) if rng.random() < 0.4 else int(rng.integers(3, 300))
        x = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        kind, k = rng.random(), len(x) // 7
        if kind < 0.4:
            y = x[rng.permutation(len(x))[: max(1, int(np.ceil(0.75 * len(x))))]]
        elif kind < 0.7:
            y = np.concatenate((x, rng.integers(0, 1 << 63, len(x) // 3, np.uint64)))
        else:
            y = np.concatenate((x[k:], rng.integers(0, 1 << 63, k, np.uint64)))
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 4 * both < 3 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        (sx, sy), needed = signed([x, y])
        assert len(sx & sy) >= needed.max()
        assert needed.max() >= 1 or len(x) < 8 or 180 < len(x) < 400  # hardly any pair is left to the comparison of loose sets


def test_subsets_are_enumerated():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 380, np.uint64))  # signs for one band only
    (sigs,), needed = signed([x])
    full = 380 // 3 // 2 + 1 + 380 // 32  # partitions that are seen, beside some that are not full
    assert 2.5 * full < len(sigs) < 4 * full  # three subsets of each
    assert needed[0] == -(-380 * 3 // 4) // 32 + 1


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_runs_through_packed_arrays(spark, ranges):
    rng = np.random.default_rng(ranges)
    have, packs = {}, []
    for _ in range(5):
        nodes = rng.integers(-50, 50, 30)
        at = np.repeat(np.arange(30), 20)
        sigs = rng.integers(0, 300, 600).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for s, k in zip(((sigs >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32) | sigs & np.uint64(0xFFFFFFFF)).tolist(), at.tolist(), strict=True):
            have.setdefault(s, set()).add(int(nodes[k]))
        packs += [(r[0], r[1], *map(bytearray, r[2:])) for r in N.pack(sigs, at, nodes, ranges)]
    packs.append((0, 2, bytearray(), bytearray(np.array([7, 8]).tobytes()), bytearray(np.array([3, 0], np.int32).tobytes())))
    got = N.shared_signatures(spark.createDataFrame(packs, "range int, kind int, sigs binary, nodes binary, places binary")).collect()
    assert {(r.node, r.needed) for r in got if r.sig is None} == {(7, 3), (8, 0)}
    runs = {}
    for r in got:
        if r.sig is not None:
            runs.setdefault(r.sig, set()).add(r.node)
    assert runs == {s: x for s, x in have.items() if len(x) > 1}


def test_sets_of_colliding_digests_stay_apart(spark, monkeypatch):
    rows = corpus(1)
    real = N.digests
    monkeypatch.setattr(N, "digests", lambda flat, offsets: (real(flat, offsets)[0] % 40, real(flat, offsets)[1]))
    cloudpickle.register_pickle_by_value(N)  # so that workers take the digests of this test, too
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = N.set_table(N.text_rows(docs, "doc_id", "text"), 5)
    try:
        assert len(N.collisions(sets)) > 10
        assert run(spark, rows) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(N)


def chain(seed):
    rng = random.Random(seed)
    ids = rng.sample(range(100), 40)
    return [(ids[k], ids[max(0, k - rng.randint(1, 3))]) for k in range(1, len(ids))]


#: In both the sum of all labels once stood still before they were settled.
@pytest.mark.parametrize("links", [[(9, 3), (8, 3), (5, 9), (1, 8), (6, 5), (7, 5), (4, 6), (2, 4)], chain(195)])
def test_components_of_chains_against_union_find(spark, links):
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {r.node: r.c for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()} == {x: root(x) for x in parent}


@pytest.mark.parametrize("block", [400_000, 1500])
def test_a_large_similar_group_gives_fewer_links_than_nodes(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(5)
    core, other = (rng.integers(0, 1 << 63, 90, np.uint64) for _ in range(2))
    rows = [(k, np.unique(np.concatenate((core if k < 60 else other, rng.integers(0, 1 << 63, 10, np.uint64)))).tobytes()) for k in range(62)]
    sets = spark.createDataFrame([(k, bytearray(s)) for k, s in rows], "node long, s binary")
    links = N.family_pairs(sets.selectExpr("node", "node AS c"), sets).collect()
    blocks = -(-60 * 100 // block)
    assert len(links) < 62 * (1 if blocks == 1 else blocks + 1)  # all pairs would be 1,771
    assert {r.c for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()} == {0, 60}
