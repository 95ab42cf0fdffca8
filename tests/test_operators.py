"""Operators against loops: packing, ranking, intervals, streams, sources."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import costs, integrity, packing
from tidewater.operators import statistics as S
from tidewater.operators.chunking import chunk_grid
from tidewater.operators.ranking import bm25, dense_topk, dot, ranked
from tidewater.sources import clients, files
from tidewater.streaming import events as E


def grids(n, seed=4):
    rng, out = random.Random(seed), []
    for k in range(n):
        size, overlap, total = rng.randint(2, 9), 0, rng.randint(1, 60)
        overlap = rng.randint(0, size // 2)
        start, spans = 0, []
        while not spans or spans[-1][1] < total:
            spans.append((start, min(start + size, total)))
            start += size - overlap
        ranks = list(range(1, len(spans) + 1))
        rng.shuffle(ranks)
        out += [(k, i, s, e, r, f"c{i}") for i, ((s, e), r) in enumerate(zip(spans, ranks, strict=True))]
    return out


def test_packers(spark):
    rows = grids(60)
    df = spark.createDataFrame(rows, "doc_id int, chunk_ord int, token_start int, token_end int, rank int, chunk_text string")
    union = {(r.doc_id, r["rank"]): (r.union_tokens, r.union_spans) for r in packing.union_costs(df).collect()}
    concat = {(r.doc_id, r["rank"]) for r in packing.pack_concat(df, [12]).collect()}
    skip = {r.doc_id: list(r.kept) for r in packing.pack_skip(df, 12).collect()}
    for k in {r[0] for r in rows}:
        covered, used, kept, total, open_ = set(), 0, [], 0, True
        for _, i, s, e, r, _ in sorted((x for x in rows if x[0] == k), key=lambda x: x[4]):
            covered |= set(range(s, e))
            assert union[k, r] == (len(covered), sum(1 for t in covered if t - 1 not in covered))
            used += e - s + (r > 1)
            open_ = open_ and used <= 12
            assert ((k, r) in concat) == open_
            if total + e - s <= 12:
                total += e - s
                kept.append(i)
        assert skip[k] == sorted(kept)


def test_bm25_keeps_chunks_without_a_hit(spark):
    docs = spark.createDataFrame([(1, "the cat sat " * 40 + "zebra crossing " * 10), (2, "")], "doc_id int, text string")
    chunks = chunk_grid(docs, 16, 4)
    got = {(r.doc_id, r.chunk_ord): r.score for r in bm25(chunks, spark.createDataFrame([(1, "zebra zebra dog"), (2, "x")], "doc_id int, query string")).collect()}
    texts = [r.chunk_text.lower().split() for r in chunks.orderBy("chunk_ord").collect()]
    n, avg = len(texts), sum(map(len, texts)) / len(texts)
    vocab = {w for t in texts for w in t}
    raw = {w: math.log(n - (d := sum(w in t for t in texts)) + 0.5) - math.log(d + 0.5) for w in vocab}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i, t in enumerate(texts):
        f = t.count("zebra")
        assert got[1, i] == pytest.approx(2 * idf["zebra"] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg)) if f else 0, abs=2e-6)
    assert len(got) == n


def test_dense_takes_probes_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id int, embedding array<float>")
    probes = v.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    want = sorted(map(tuple, dense_topk(probes, v, 3).collect()))
    assert len(want) == 120
    for block in (1, 7, 40):
        assert sorted(map(tuple, dense_topk(probes, v, 3, block).collect())) == want


def test_dense_blocks_give_the_rows_of_all_pairs(spark):
    """In a loop of rows of its own, with odd vectors, ties, a common vector and values that round either way."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist() if i % 3 else rng.normal(size=3).round(4).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0]) for i in range(40)]
    rows += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan"), 0.0, 0.0]), (403, [1.0]), (404, [float("inf"), 1.0, 1.0]), (405, [1e200, 1.0, -1e200])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    probes = v.where("vec_id % 10 < 2 OR vec_id > 399").selectExpr("vec_id AS probe_id", "embedding AS probe")
    pairs = probes.join(v, F.col("vec_id") != F.col("probe_id")).select("probe_id", "vec_id", F.round(dot(F.col("probe"), F.col("embedding")), 5).alias("score"))
    want = sorted(map(str, ranked(pairs, "probe_id", "score", "vec_id").where("rank <= 7").collect()))
    for block, vectors in ((4000, 8000), (20, 50)):
        got = dense_topk(probes, v, 7, block, vectors)
        assert sorted(map(str, got.collect())) == want
        assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_numpy_bootstrap(spark):
    rows = [("m", s, c, float(c * s + c), 2) for s in range(2) for c in range(5)]
    df = spark.createDataFrame(rows, "method string, stratum int, cluster int, cluster_sum double, cluster_n long")
    got = S.cluster_bootstrap(df, ["method"], 200, 3).first()
    rng, draws = np.random.default_rng(3), []
    for _ in range(200):
        total = size = 0
        for s in range(2):
            sums = np.array([r[3] for r in rows if r[1] == s])
            pick = rng.integers(0, 5, 5)
            total, size = total + sums[pick].sum(), size + 10
        draws.append(total / size)
    assert (got.lo, got.hi) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])))
    assert got.estimate == pytest.approx(sum(r[3] for r in rows) / 20)


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_stream_fold_is_the_batch_fold_in_any_order(spark, tmp_path, seed):
    """Events of 12 requests, in order or permuted, an event or several a micro-batch."""
    import datetime

    from tidewater.plans.events import parts

    rng = random.Random(seed)
    rows = [r for r in parts(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp")).collect() if r.request_id % 1009 < 12]
    schema = "request_id long, seq long, ts timestamp, text string, thought boolean, finish string, prompt long, output long, total long, candidates int"
    batch = {r.request_id: (r.text, r.finish, r.prompt, r.output, r.total, r.n_events) for r in E.fold(spark.createDataFrame(rows, schema)).collect()}
    if seed is not None:
        rng.shuffle(rows)
    else:
        rows.sort(key=lambda r: (r.request_id, r.seq))
    files = [rows[k::6] for k in range(6)]
    last = max(r.ts for r in rows)
    files.append([(None, 1, last + datetime.timedelta(days=400), *[None] * 7)])
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        os.utime(next((tmp_path / "in" / str(k)).glob("part-*.parquet")), (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = E.fold_stream(stream, "1000 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    out.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(E.OUTPUT).parquet(f"{tmp_path}/out").count() == 0  # within the delay nothing is settled
    spark.createDataFrame([(None, 2, last + datetime.timedelta(days=1500), *[None] * 7)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(E.OUTPUT).parquet(f"{tmp_path}/out").where("request_id IS NOT NULL").collect()
    assert len(got) == len(batch)
    assert {r.request_id: (r.text, r.finish, r.prompt, r.output, r.total, r.n_events) for r in got} == batch


def test_requests_of_one_bucket_settle_each_at_its_time(spark, tmp_path):
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "request_id long, seq long, ts timestamp, text string, thought boolean, finish string, prompt long, output long, total long, candidates int"
    event = lambda r, seq, h, text: (r, seq, at(h), text, False, None, 1 << 60 if seq == 1 else None, None, None, 1)
    big = (1 << 60) + 1
    files = [[event(big, 2, 0, "b"), event(5, 1, 0, "x")], [event(5, 2, 10, "y")], [event(5, 3, 9.5, "z"), event(big, 1, 9.5, "late")], [event(None, 1, 30, None)]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        os.utime(next((tmp_path / "in" / str(k)).glob("part-*.parquet")), (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = E.fold_stream(stream, buckets=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(E.OUTPUT).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.request_id, r.text, r.prompt, r.n_events) for r in got if r.request_id == 5) == [(5, "xyz", 1 << 60, 3)]
    assert sorted(r.n_events for r in got if r.request_id == big) in ([2], [1, 1])  # given out before or with what came late


def test_costs_and_labels(spark):
    df = spark.createDataFrame([("32000", 32000), ("INF", None), ("500", 500)], "label string, n int")
    got = df.select(costs.budget_from_label(F.col("label")).alias("b"), costs.budget_label(F.col("n")).alias("l"), "n").collect()
    assert [(r.b, r.l) for r in got] == [(32000, "32K"), (None, "inf"), (500, "500")]
    row = spark.range(1).select(costs.gpu_cost(F.lit("none such"), F.lit(10.0), {"L4": 0.71}).alias("g"), costs.serving_cost(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)).alias("s")).first()
    assert (row.g, row.s) == (0.0, None)


def test_files(spark, tmp_path):
    (tmp_path / "ctx").mkdir()
    (tmp_path / "ctx/a.txt").write_bytes(b"x\r\ny\n")
    (tmp_path / "ctx/b.txt").write_bytes("é".encode())
    assert {r.example_id: r.context for r in files.read_texts(spark, f"{tmp_path}/ctx").collect()} == {"a": "x\r\ny\n", "b": "é"}
    (tmp_path / "in.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, f"{tmp_path}/in.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/q1.json").write_text(json.dumps({"support_facts": [{"text": "t", "char_start": 1}, {"text": "u", "char_start": 5}]}, indent=1))
    got = files.read_sidecars(spark, f"{tmp_path}/ev", spark.createDataFrame([], "text string, char_start int").schema).collect()
    assert [(r.example_id, r.ev_ord, r.text) for r in got] == [("q1", 0, "t"), ("q1", 1, "u")]
    one = spark.createDataFrame([("a",)], "name string")
    assert files.read_exactly_one(spark, f"{tmp_path}/ctx", one).first().context == "x\r\ny\n"
    with pytest.raises(Exception, match="exactly one"):
        files.read_exactly_one(spark, f"{tmp_path}/ctx", spark.createDataFrame([("zz",)], "name string")).collect()
    files.write_selections(spark.createDataFrame([("d", "m", 1)], "dataset string, method string, n int"), f"{tmp_path}/sel")
    assert spark.read.json(f"{tmp_path}/sel").count() == 1
    files.replace_json({"a": [1]}, f"{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": [1]}
    table = spark.createDataFrame([("head", "x", 1.25), ("head", "y", None)], "m string, d string, v double")
    assert files.latex(table, "m", "d", "v", ["x", "y"]).splitlines()[1] == r"head & 1.2 & -- \\"
    assert files.markdown(table).splitlines()[3] == "| head | y | - |"
    sums = files.checksums(spark, f"{tmp_path}/ctx")
    assert {r.status for r in integrity.manifest_diff(sums, sums).collect()} == {"ok"}


def test_clients_record_failures_and_resume(spark):
    def flaky(prompt, seed):
        if "bad" in prompt:
            raise TimeoutError("read timed out")
        return clients.echo_client(prompt, seed)

    tasks = spark.createDataFrame([("1", "a\nb", 0), ("2", "bad", 0)], "key string, prompt string, seed int")
    receipts = clients.answer(tasks, flaky)
    assert {r.key: (r.output, r.error) for r in receipts.collect()} == {"1": ("b", None), "2": (None, "TimeoutError: read timed out")}
    assert [r.key for r in clients.pending(tasks, receipts).collect()] == ["2"]


def test_guards(spark):
    with pytest.raises(ValueError):
        integrity.require_one(spark.createDataFrame([(1,), (2,)], "f int"), "f")
    assert not integrity.publishable(spark.createDataFrame([(True,), (None,)], "ok boolean"), F.col("ok"))


def test_byte_tokens(spark):
    import public_tokenizers

    from tidewater.operators import byte_tokens as B

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = B.encoding(path)
    assert coder.encode_ordinary("a<|endoftext|>") == coder.encode("a<|endoftext|>", disallowed_special=())
    rng = random.Random(6)
    texts = ["", None, "日本語のテキスト 😀👍🏽 " * 30, "one two three " * 60, "".join(rng.choices("aé日 😀\n.", k=400))]
    rows = spark.createDataFrame([(k, t, "two 日本語のテキスト") for k, t in enumerate(texts)], "doc_id int, text string, query string")
    for budget in (0, 7, 40, 10_000):
        got = {r.doc_id: r for r in B.pack_by_tokens(rows, path, budget, 16, 4).collect()}
        for k, t in enumerate(texts):
            r = got[k]
            assert r.selected_tokens == len(coder.encode_ordinary(r.filtered_text)) <= budget
            parts = r.filtered_text.split("\n") if "\n" not in (t or "") else []
            assert all(p in (t or "") for p in parts)
            if budget == 10_000:
                assert r.kept_chunks == r.n_chunks and r.filtered_text == (t or "")
    source = B.Source("日😀é", path)
    for a in range(len(source.ids) + 1):
        for b in range(a, len(source.ids) + 1):
            spans = source.union([(a, b)])
            assert source.render(spans) in "日😀é"
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.clip(path, 9)(F.col("t")).alias("c"), B.count(path)(F.col("t")).alias("n")).collect()
    for r in cut:
        assert r.n == len(coder.encode_ordinary(r.t or "")) and len(coder.encode_ordinary(r.c or "")) <= 9
        assert (r.t or "").startswith(r.c or "") and (r.n > 9 or r.c == r.t)


def test_spending_and_selection_guards(spark):
    from tidewater.operators import selection as X
    from tidewater.operators import spend

    log = [("a", 1, "reader", "reserve", 2.0), ("a", 2, "reader", "settle", 1.5), ("a", 3, "reader", "reserve", 9.0), ("b", 1, "judge", "reserve", 4.0), ("c", 1, "judge", "settle", 4.0)]
    got = {r.key: (r.reserved, r.cost, r.refused, r.state, r.blocked) for r in spend.states(spark.createDataFrame(log, "key string, seq int, category string, action string, amount double")).collect()}
    assert got == {"a": (2.0, 1.5, 1, "complete", False), "b": (4.0, None, 0, "reserved", True)}
    asked = spark.createDataFrame([("x", "r", 1, 6.0), ("y", "r", 2, 5.0), ("z", "r", 3, 1.0), ("n", "r", 0, -1.0), ("u", "none", 1, 1.0)], "key string, category string, seq int, amount double")
    granted = {r.key for r in spend.within_ceiling(asked, spark.createDataFrame([("r", 10.0)], "category string, ceiling double")).where("granted").collect()}
    assert granted == {"x", "y"}
    df = spark.createDataFrame([(["a::0", "a::1", "a::9", "bad", "b::x"],)], "ids array<string>")
    assert [tuple(x) for x in df.select(X.spans_of_ids(F.col("ids"), 64, 16).alias("m")).first().m] == [(0, 112), (432, 496)]
    with pytest.raises(ValueError):
        X.require_count(df, 2)
    assert X.require_count(df, 1) is df and X.require_count(df, None) is df


def test_prices_and_pairs_that_raise(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"models": {"m": {"input_per_1m": 1, "output_per_1m": 2, "thinking_per_1m": 5}}, "gpu_hourly": {"g": 0.5}}))
    prices, hourly = costs.read_prices(str(path))
    calls = spark.createDataFrame([("m", 1_000_000, 500_000, 100_000), ("other", 1, 1, 1)], "model string, input_tokens long, output_tokens long, thought_tokens long")
    got = {r.model: r.cost for r in costs.api_cost(calls, costs.model_prices(spark, prices)).collect()}
    assert got == {"m": 2.5, "other": None} and hourly == {"g": 0.5}
    with pytest.raises(Exception, match="no price for model other"):
        costs.api_cost(calls, costs.model_prices(spark, prices), strict=True).collect()
    schema = "example_id int, cluster string, value double, evaluable boolean"
    left, right = ([(k, f"c{k % n}", float(k), True) for k in range(4)] for n in (1, 1))
    with pytest.raises(Exception, match="two independent clusters"):
        S.paired_interval(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    with pytest.raises(Exception, match="two clusters"):
        S.paired_interval(spark.createDataFrame(left, schema), spark.createDataFrame([(k, "x", 1.0, True) for k in range(4)], schema)).collect()
    with pytest.raises(ValueError):
        files.markdown(spark.range(10_001))


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_running_sums_by_blocks(spark, block):
    from tidewater.operators import prepare

    rng = random.Random(block)
    rows = [(rng.choice("aaab"), rng.randrange(40), k, rng.randrange(5)) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, place long, k int, n int")
    got = {r.k: r.running for r in prepare.running_sum(df, "key", "place", ["k"], "n", block).collect()}
    for key, place, k, _ in rows:
        assert got[k] == sum(n for a, p, j, n in rows if a == key and (p, j) <= (place, k))


def test_titles_of_an_unknown_type_raise(spark):
    from tidewater.operators import prepare

    with pytest.raises(Exception, match="no title line for poem"):
        spark.range(1).select(prepare.by_type(F.lit("poem"), F.lit("n"), F.lit("t"))).collect()
