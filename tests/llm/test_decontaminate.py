import random
import time
import tracemalloc

import numpy as np

from tidewater.llm.decontaminate import SPACED, Block, drop_contaminated, find_contamination, tiles


def words(text):
    return text.lower().encode("utf-8", "replace").translate(SPACED).split()


def brute_tiles(item, text, least):
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(text)):
                n = 0
                while q + n < len(item) and p + n < len(text) and free_i[q + n] and free_t[p + n] and item[q + n] == text[p + n]:
                    n += 1
                if n >= least and (-n, q, p) < (-best[2], best[0], best[1]):
                    best = (q, p, n)
        if not best[2]:
            return out
        out.append(best)
        q, p, n = best
        free_i[q : q + n] = [False] * n
        free_t[p : p + n] = [False] * n


def test_tiles_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        item, text = ([rng.randrange(1, 4) for _ in range(rng.randrange(14))] for _ in "ab")
        for least in (1, 2, 3):
            assert tiles(np.array(item, np.uint64), np.array(text, np.uint64), least) == brute_tiles(item, text, least)


def test_passages_are_found_in_order_or_not(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(5)]
    noise = lambda n: " ".join(word() for _ in range(n))
    parts = items[1][1].split()
    texts = [
        noise(50) + " " + items[0][1].upper().replace(" ", ",  ") + ". " + noise(20), " ".join(parts[20:] + [noise(9)] + parts[:20]), noise(200), " ".join(items[2][1].split()[:15]) + noise(30),
        " ".join(w for w in items[3][1].split()[::-1]), None, "", " ".join(items[4][1].split()[:24]), items[0][1] + " " + items[1][1], "long " * 200_000 + items[2][1],
    ]
    docs = spark.createDataFrame([(i, t, 9, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int, coverage double")
    bench = spark.createDataFrame([*items, (7, None), (8, "too shorty"), (9, "")], "item_id long, text string")
    for block in (16 << 20, 300):
        got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles) for r in find_contamination(docs, bench, block_bytes=block).collect()}
        assert got == {(0, 0): (1.0, 1), (1, 1): (1.0, 2), (7, 4): (0.6, 1), (8, 0): (1.0, 1), (8, 1): (1.0, 1), (9, 2): (1.0, 1)}
        assert sorted(r.doc_id for r in drop_contaminated(docs, bench, block_bytes=block).collect()) == [2, 3, 4, 5, 6]
    assert find_contamination(docs.limit(0), bench).count() == find_contamination(docs, bench.limit(0)).count() == 0


def test_given_documents(spark):
    from tidewater.llm.queries import op8_decontamination, table

    sf = "/root/testdata/sf0.01"
    items = {r.item_id: words(r.text) for r in table(spark, sf, "benchmark").collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        w = words(r.text)
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, g in grams.items():
            if g & mine and (c := sum(n for _, _, n in brute_tiles(items[i], [x if x in set(items[i]) else None for x in w], 5))) >= 0.5 * len(items[i]):
                want[r.doc_id, i] = c / len(items[i])
    assert {(r.doc_id, r.item_id): r.coverage for r in op8_decontamination(spark, sf).collect()} == want and want


def found(block, text):
    return [x[1:] for x in block.find_all([text])]


def test_repeated_seeds():
    block = Block.of([(1, "a b c d e f g h i j")], 5, 0.5)
    assert found(block, "a b c d e f g h i j " * 500) == [(1, 1.0, 1)]
    assert found(block, "f g h i j x a b c d e") == [(1, 1.0, 2)]


def test_short_items_are_matched_whole():
    block = Block.of([(1, "one two three"), (2, ""), (3, "the quick brown fox jumps over it"), (4, "solo")], 5, 0.5)
    assert list(block.find_all(["x one two three y", "one two", "", "solo the quick brown fox jumps"])) == [(3, 4, 1.0, 1), (0, 1, 1.0, 1), (3, 3, 5 / 7, 1)]


def test_one_repeated_word_in_bounded_time_and_memory():
    block = Block.of([(1, "word " * 600), (2, "word " * 600 + "end")], 5, 0.5)
    tracemalloc.start()
    t = time.time()
    assert found(block, "word " * 12_000) == [(1, 1.0, 1), (2, 600 / 601, 1)]
    assert time.time() - t < 2 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
