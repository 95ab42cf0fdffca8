import hashlib

import tiktoken

import corpus_pipeline as C
from tests.llm.test_ngram_join import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import public_tokenizers as P

    from tidewater.llm.bpe import tiktoken_ranks
    from tidewater.llm.decontaminate import find_contamination
    from tidewater.llm.language_id import LETTER
    from tidewater.llm.queries import table
    from tidewater.llm.shared import materialise

    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "12 34", "en", "s", 5), (10_003, "", "en", "s", 0)], docs.schema)
    docs = materialise(docs.unionByName(extra), "docs")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(C.STAGES):
        out = materialise(stage(spark, docs, SF), f"t{k}")
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and all(texts[r.doc_id] == r.text for r in rows)
            kept = {r.doc_id for r in rows}
        if k == 0:
            want = {i for i, t in texts.items() if t and LETTER.search(t)}
        elif k == 1:
            last = {}
            for i, t in texts.items():
                last[t.translate(lower)] = max(i, last.get(t.translate(lower), i))
            want = set(last.values())
        elif k == 2:
            want = {i for i, (_, c) in components(list(texts.items())).items() if c == i}
        elif k == 3:
            want = set(texts) - {r.doc_id for r in find_contamination(docs, table(spark, SF, "benchmark")).collect()}
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert all(not any(x in texts[i] for x in items) for i in want)
        if k < 4:
            assert kept == want and len(rows) == len(kept)
            texts = {i: texts[i] for i in kept}
            docs = out
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tiktoken_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_run(spark):
    rows = C.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 100


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, __language string, language string, row long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in rows], SCHEMA)


def kept(out, docs):
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text.lower()) for r in out.collect()), key=str)


def test_stages_drop_rows_and_not_ids(spark):
    rows = [(1, "r"), (1, "r"), (1, "R"), (None, "n"), (2, "N"), (None, "only"), (None, "only"), (5, "a"), (9, "a"), (5, "b"), (3, "one"), (None, None), (4, "12 34")]
    docs = rows_of(spark, rows)
    assert len(kept(C.language_stage(spark, docs, SF), docs)) == 11
    docs = rows_of(spark, rows[:-2])
    want = sorted([(1, "r"), (2, "n"), (None, "only"), (9, "a"), (5, "b"), (3, "one")], key=str)
    assert kept(C.exact_stage(spark, docs, SF), docs) == want
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base), (7, base + " x"), (7, "an other text that nothing else has"), (None, base + " y"), (8, base + " z"), (8, base + " z"), (None, "lone text of some words here"), (6, ""), (6, "")]
    docs = rows_of(spark, rows)
    assert kept(C.near_stage(spark, docs, SF), docs) == sorted([(3, base), (7, rows[2][1]), (None, rows[6][1]), (6, ""), (6, "")], key=str)
    assert C.benchmark_stage(spark, docs, SF).count() == 9
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_stage_leaves_what_others_still_read(spark):
    long = " ".join(f"w{k}" for k in range(80))
    one = rows_of(spark, [(1, "a"), (2, "A"), (None, "a"), (3, long), (4, long + " x")])
    for _, stage in C.STAGES[:4]:
        first = stage(spark, one, SF)
        want = sorted(map(tuple, first.collect()), key=str)
        for _, other in C.STAGES[:4]:
            other(spark, one, SF).count()
        assert sorted(map(tuple, first.collect()), key=str) == want


def test_very_long_texts_and_what_is_written(spark):
    from tidewater.llm.shared import noting

    text = " ".join(f"w{k % 90_000}" for k in range(400_000))
    docs = rows_of(spark, [(1, text), (2, text.upper()), (3, text + " end"), (4, "short text here")])
    written = []
    with noting(written):
        for _, stage in C.STAGES[:4]:
            docs = stage(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [2, 4]


def test_items_that_repeat_are_dealt_once(spark):
    from tidewater.llm.decontaminate import blocks_of, drop_contaminated, find_contamination

    passage = " ".join(f"word{k}" for k in range(40))
    items = spark.createDataFrame([(k, passage) for k in range(300)], "item_id long, text string")
    docs = rows_of(spark, [(1, "before " + passage + " after"), (2, "nothing of it"), (None, passage)])
    assert [r.doc_id for r in drop_contaminated(docs, items, block_bytes=2_000).collect()] == [2]
    count, blocks = blocks_of(items.withColumnRenamed("text", "t"), 5, 0.5, 20_000)
    sizes = [len(b.ids) for b in blocks]
    assert count > 2 and sum(sizes) == 300 and max(sizes) < 150
    assert find_contamination(docs, items.limit(3)).count() == 6
