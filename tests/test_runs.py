"""Indexed lines, runs that are taken up again, the judgment store, folds by blocks, shards and audits."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import constraints as C
from tidewater.operators import shards, spend
from tidewater.operators import statistics as S
from tidewater.operators.prefix import fold_before
from tidewater.sources import indexed, judgments
from tidewater.streaming.runs import Run

LINE = "method string, example_id long, text string, error string, repair_of string"
KEYS = ["method", "example_id"]


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" if r else "\n" for r in rows), encoding="utf-8")


def index_of(spark, path, **options):
    return indexed.index_lines(spark, f"file://{path}", LINE, KEYS, ["method", "example_id", "text"], F.col("error").isNotNull(), **options)


def test_lines_are_found_in_any_ranges():
    rng = random.Random(3)
    lines = [("é" * rng.randrange(30) + "x").encode() if rng.random() < 0.8 else b"" for _ in range(60)]
    for data in (b"\n".join(lines), b"\n".join(lines) + b"\n", b"", b"\n\n"):
        want = [(a, x) for a, x in offsets(data) if x.strip()]
        for size in (1, 7, 50, 10_000):
            got = [x for a in range(0, len(data), size) for x in indexed.lines_from(io.BytesIO(data), a, min(a + size, len(data)))]
            assert got == want


def offsets(data):
    at = 0
    for line in io.BytesIO(data):
        yield at, line
        at += len(line)


def test_lookups_read_what_they_ask_for():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    data = b"".join(b"%07d\n" % k * 16 for k in range(20_000))  # 128 bytes a line
    entries = [(128 * k, 128) for k in range(0, 20_000, 100)] + [(128 * 19_950, 128), (128 * 19_951, 128)]
    f = Counting(data)
    assert list(indexed.read_runs(f, entries)) == [data[a : a + n] for a, n in entries]
    assert f.taken <= 128 * (len(entries) + 51)  # 1 % of the bytes, and what lies between two near ones


def test_index_and_lookup(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda k, text, error=None, method="m": {"method": method, "example_id": k, "text": text, "error": error}
    write_lines(folder / "a.jsonl", [row(1, None, "timeout"), row(2, "two é"), None, row(3, None, "late"), row(5, "five"), row(5, None, "late")])
    write_lines(folder / "b.jsonl", [row(1, "one"), row(2, "two é"), row(4, "x" * 5000), row(1, "one", method="other")])
    for size in (40, 1 << 20):
        index = indexed.save_index(indexed.chosen_entries(index_of(spark, folder, range_bytes=size), KEYS), f"file://{tmp_path}/index{size}", KEYS)
        got = {(r.method, r.example_id): (r.text, r.error) for r in indexed.read_entries(index, f"file://{folder}", LINE).collect()}
        assert got == {("m", 1): ("one", None), ("m", 2): ("two é", None), ("m", 3): (None, "late"), ("m", 4): ("x" * 5000, None), ("m", 5): ("five", None), ("other", 1): ("one", None)}
        some = index.where("method = 'm' AND example_id IN (3, 4)")
        assert "PushedFilters: [IsNotNull(method)" in some._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.example_id for r in indexed.read_entries(some, f"file://{folder}", LINE).collect()) == [3, 4]
    write_lines(folder / "c.jsonl", [row(2, "another two")])
    with pytest.raises(Exception, match="conflicting successes"):
        indexed.chosen_entries(index_of(spark, folder), KEYS).collect()


def test_repairs_replace_failures_alone(spark, tmp_path):
    write_lines(tmp_path / "a.jsonl", [{"method": "m", "example_id": 1, "error": "late"}, {"method": "m", "example_id": 2, "text": "two"}])
    entries = indexed.chosen_entries(index_of(spark, tmp_path / "a.jsonl"), KEYS)
    fix = lambda k, of: spark.createDataFrame([("m", k, "fixed", 0, 10, "d", False, of)], "method string, example_id long, path string, offset long, length long, digest string, failed boolean, repair_of string")
    path = str(tmp_path / "a.jsonl")
    got = {r.example_id: (r.path, r.failed) for r in indexed.repaired_entries(entries, fix(1, path), KEYS).collect()}
    assert got == {1: ("fixed", False), 2: (path, False)}
    for repair in (fix(1, "elsewhere"), fix(2, path), fix(9, path)):
        with pytest.raises(Exception, match="replaces no failure"):
            indexed.repaired_entries(entries, repair, KEYS).collect()


def counting_client(folder, fails=()):
    """A client that leaves a file for each call."""
    import os
    import uuid

    def call(prompt, seed):
        open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
        if prompt in fails:
            raise TimeoutError("no answer")
        return f"answer to {prompt}", 100, 10, "STOP"

    return call


TASK = "key string, prompt string, seed long, category string, amount double"


def test_a_run_is_taken_up_without_a_second_call(spark, tmp_path):
    calls, tasks = tmp_path / "calls", tmp_path / "tasks"
    calls.mkdir()
    made = lambda: sorted(f.name.split("-")[0] for f in calls.iterdir())
    spark.createDataFrame([(f"k{k}", f"p{k}", k, "reader", 0.1) for k in range(6)] + [("k0", "p0", 0, "reader", 0.1)], TASK).write.parquet(f"file://{tasks}")

    def stop():
        raise RuntimeError("killed")

    folder = f"file://{tmp_path}/run"
    stream = lambda: spark.readStream.schema(TASK).parquet(f"file://{tasks}")
    with pytest.raises(Exception, match="killed"):
        Run(folder, "f1", counting_client(str(calls), ("p4",)), after_receipts=stop).stream(stream()).awaitTermination()
    assert made() == [f"p{k}" for k in range(6)]
    Run(folder, "f1", counting_client(str(calls))).stream(stream()).awaitTermination()  # the batch is given again: only the failure is
    assert made() == sorted([f"p{k}" for k in range(6)] + ["p4"])
    spark.createDataFrame([("k1", "p1", 1, "reader", 0.1), ("k9", "p9", 9, "reader", 0.1)], TASK).write.mode("append").parquet(f"file://{tasks}")
    run = Run(folder, "f1", counting_client(str(calls)))
    run.stream(stream()).awaitTermination()
    assert made()[-1] == "p9" and len(made()) == 8
    good = run.receipts(spark).where("error IS NULL")
    assert good.count() == good.select("key").distinct().count() == 7
    with pytest.raises(ValueError, match="another fingerprint"):
        Run(folder, "f2").batch(spark.createDataFrame([], TASK))
    with pytest.raises(ValueError, match="another fingerprint"):
        Run(folder, "f2").stream(stream())


def test_reserved_calls_without_a_receipt_are_in_doubt(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    run = Run(f"file://{tmp_path}/run", "f", counting_client(str(calls)), {"reader": 0.35})
    spark.createDataFrame([("lost", "reader", 0.1, "0-x")], "key string, category string, amount double, attempt string").write.parquet(f"{run.folder}/reservations")
    tasks = spark.createDataFrame([(k, k, 1, "reader", 0.1) for k in ("lost", "a", "b", "c")] + [("d", "d", 1, "unknown", 0.1)], TASK)
    run.batch(tasks)
    assert "lost" not in {f.name.split("-")[0] for f in calls.iterdir()} and len(list(calls.iterdir())) == 2  # 0.1 is reserved, 0.25 left
    assert [r.key for r in run.in_doubt(spark).collect()] == ["lost"]
    assert {r.category: round(r.spent, 6) for r in run.spent(spark).collect()} == {"reader": round(0.1 + 2 * (100 * 0.1 + 10 * 0.4) / 1e6, 6)}
    run.batch(tasks)  # answers cost less than was reserved, so there is room for the third
    assert len(list(calls.iterdir())) == 3


def test_judgment_store(spark, tmp_path):
    body = [("r1", "judge", "a"), ("r2", "judge", "a"), ("r3", "judge", "b"), ("r4", "judge", "c"), ("r5", "judge", "d"), ("r6", "judge", "d")]
    asked = spark.createDataFrame(body, "id string, model string, body string").withColumn("request_sha256", judgments.request_digest(F.col("model"), F.col("body")))
    judgments.open_store(spark, "store_of_test", f"file://{tmp_path}/store", 4)
    columns = "request_sha256 string, model string, verdict string, prompt_tokens long, output_tokens long, cost double"
    of = {r.body: r.request_sha256 for r in asked.collect()}
    judgments.add_judgments("store_of_test", spark.createDataFrame([(of["a"], "judge", "yes", 5, 1, 0.1), (of["a"], "judge", "no", 5, 1, 0.2), (of["b"], "older", "no", 5, 1, 0.1), (of["c"], "judge", "no", None, 1, 0.1)], columns), 4)
    found = judgments.look_up(asked, "store_of_test")
    assert {r.id: (r.status, r.verdict) for r in found.collect()} == {"r1": ("hit", "no"), "r2": ("hit", "no"), "r3": ("stale_model", "no"), "r4": ("missing_usage", "no"), "r5": ("miss", None), "r6": ("miss", None)}
    assert judgments.to_call(found).count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = judgments.look_up(asked, "store_of_test")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the requests alone are shuffled
    spark.sql("DROP TABLE store_of_test")


@pytest.mark.parametrize("block", [1, 10, 1000])
def test_folds_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.randrange(50)) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, seq int, v int")
    for fold, take in (("sum", sum), ("max", max), ("min", min)):
        for r in fold_before(df, ["key"], ["seq"], "v", fold, "got", block).collect():
            before = [v for k, s, v in rows if k == r.key and s < r.seq]
            assert r.got == (take(before) if before else None)
    assert fold_before(df.limit(0), ["key"], ["seq"], "v", "sum", "got", block).count() == 0


def test_ceilings_and_frontiers_of_one_hot_key(spark):
    rows = [(f"k{k:03}", "hot", k, 1.0) for k in range(200)]
    asked = spark.createDataFrame(rows, "key string, category string, seq int, amount double").repartition(5)
    ceilings = spark.createDataFrame([("hot", 77.0)], "category string, ceiling double")
    for block in (10, 1 << 18):
        got = spend.within_ceiling(asked, ceilings, block).collect()
        assert {r.key for r in got if r.granted} == {f"k{k:03}" for k in range(77)} and {r.spent for r in got} == {float(k) for k in range(200)}
        points = spark.createDataFrame([("a", k % 37, (k * 7919) % 101) for k in range(300)], "g string, x int, y int")
        best = {(r.x, r.y) for r in S.pareto(points, "x", "y", ["g"], block).collect()}
        each = {(r.x, r.y) for r in points.collect()}
        assert best == {(x, y) for x, y in each if not any(a <= x and b >= y and (a, b) != (x, y) for a, b in each)}


def test_stratified_bootstrap_against_a_loop(spark):
    import numpy as np

    rng = random.Random(1)
    rows = [("m" if c % 3 else "n", c % 2, c, float(rng.randrange(9)), rng.randrange(1, 5)) for c in range(40)]
    got = {r.method: r for r in S.stratified_bootstrap(spark.createDataFrame(rows, "method string, stratum int, cluster int, cluster_sum double, cluster_n int"), 50, ["method"], block_rows=7).collect()}
    for m in ("m", "n"):
        strata = {}
        for _, s, c, total, n in sorted(r for r in rows if r[0] == m):
            strata.setdefault(s, []).append((total, n))
        xs = []
        for r in range(50):
            total = size = 0
            for number, (_, each) in enumerate(sorted(strata.items()), 1):
                for i in range(len(each)):
                    pick = each[(r * 7919 + (i + number * S.STRATUM_STEP) * 104729 + 12345) * 1103515245 % 2147483648 % len(each)]
                    total, size = total + pick[0], size + pick[1]
            xs.append(total / size)
        assert (got[m].lo, got[m].hi) == tuple(np.round(np.quantile(xs, [0.025, 0.975]), 6))
        assert got[m].n_clusters == sum(map(len, strata.values()))


def test_shard_coverage(spark):
    held = [("a", n) for n in range(0, 40_000)] + [("b", n) for n in range(39_990, 70_000)] + [("c", 5), ("c", 5), ("c", 999_999)]
    expected = spark.range(70_010).withColumnRenamed("id", "n")
    got = {r.bucket: tuple(r)[1:] for r in shards.shard_coverage(spark.createDataFrame(held, "shard string, n long"), expected, "shard", "n").collect()}
    assert got == {1: (32768, 32768, 1, 0, 0), 2: (32768, 32768, 10, 0, 0), 3: (4474, 4464, 0, 10, 0), 31: (0, 1, 0, 0, 1)}


def test_digests_of_cells_ignore_order_and_tell_rows_apart(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 1, "a"), ("x", 2, None), ("y", 1, ""), ("z", 12, "3"), ("w", 1, "23")], "cell string, n int, t string")
    same = lambda a, b: {r.cell: r.same for r in shards.reruns_agree(a, b, ["cell"], ["n", "t"]).collect()}
    assert set(same(df, df.repartition(5).orderBy(F.desc("t"))).values()) == {True}
    assert same(df, df.dropDuplicates())["x"] is False and same(df, df.fillna(""))["x"] is False
    assert same(df, df.where("cell <> 'y'"))["y"] is False
    digests = {r.cell: r.digest for r in shards.multiset_digest(df, ["cell"], ["n", "t"]).collect()}
    assert digests["z"] != digests["w"]


def test_every_kind_of_rule_can_fail(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, None, "y"), (2, 7, "z"), (None, 9, "x")], "id int, ref int, t string")
    b = spark.createDataFrame([(5,), (9,)], "id int")
    rules = [
        C.Row("short", "a", F.length("t") == 1), C.Row("not y", "a", F.col("t") != "y"), C.Row("has ref", "a", F.col("ref") > 0), C.Unique("a id", "a", "id"), C.Unique("b id", "b", "id"), C.Unique("a t", "a", "t"),
        C.Foreign("a ref", "a", "ref", "b", "id"), C.Foreign("b in a", "b", "id", "a", "ref"), C.Count("some", "a", 1, 4), C.Count("few", "a", 0, 2), C.Count("many", "b", 5), C.Count("x", "a", 2, 2, F.col("t") == "x"), C.Same("alike", "a", "b"), C.Same("two", "a", "b", F.col("t") == "x"),
    ]
    found = C.audit({"a": a, "b": b}, rules)
    got = {r.rule: (r.checked, r.failed) for r in found.collect()}
    assert got == {"short": (4, 0), "not y": (4, 1), "has ref": (4, 1), "a id": (4, 3), "b id": (2, 0), "a t": (4, 2), "a ref": (3, 1), "b in a": (2, 0), "some": (4, 0), "few": (4, 2), "many": (2, 3), "x": (2, 0), "alike": (4, 2), "two": (2, 0)}
    with pytest.raises(ValueError, match="a id, a ref, a t, alike, few, has ref, many, not y"):
        C.require_passed(found)
    assert C.require_passed(found.where("passed")).count() == 6
    empty = C.audit({"a": a.limit(0), "b": b.limit(0)}, rules)
    assert {r.rule for r in empty.where("NOT passed").collect()} == {"some", "many", "x"}
    with pytest.raises(ValueError, match="one name"):
        C.audit({"a": a}, [C.Unique("n", "a", "id"), C.Unique("n", "a", "t")])


def test_layouts_are_made_once(spark, tmp_path):
    from tidewater.functions.tokens import pieces
    from tidewater.operators import layouts
    from tidewater.operators.chunking import chunk_grid

    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é \n", k=rng.choice([0, 1, 40, 3000]))) for _ in range(12)] + ["a b", "a b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    layouts.open_layouts(spark, "layouts_of_test", f"file://{tmp_path}/layouts", 4)
    layouts.lay_out(docs, "layouts_of_test", "first", buckets=4)
    count = spark.table("layouts_of_test").count()
    assert count == len({t or "" for t in texts})
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, "now another text").otherwise(F.col("text")))
    layouts.lay_out(changed, "layouts_of_test", "second", buckets=4)
    assert spark.table("layouts_of_test").where("made = 'second'").count() == 1 and spark.table("layouts_of_test").count() == count + 1
    rows = layouts.with_layout(changed.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "layouts_of_test")
    for r in rows.withColumn("p", pieces(F.col("text"))).collect():
        ends = [sum(map(len, r.p[: k + 1])) for k in range(len(r.p))]
        assert list(r.ends) == ends
    chunks = rows.select("doc_id", "text", F.inline(layouts.chunk_spans(F.col("ends")))).selectExpr("doc_id", "chunk_ord", "token_start", "token_end", "substring(text, char_start + 1, char_end - char_start) AS chunk_text")
    grid = chunk_grid(changed).select(*chunks.columns)
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, grid.collect())) != []
    spark.sql("DROP TABLE layouts_of_test")


def test_spans_of_a_long_text_are_found_in_one_walk(spark):
    import time

    from tidewater.functions.tokens import pieces
    from tidewater.operators import selection

    text = " ".join(f"w{k}" for k in range(100_000))
    df = spark.createDataFrame([(text, text.index(" w70000 ") + 1, text.index(" w70003 ")), ("a bc d", 2, 4), ("a bc d", 0, 0)], "text string, s int, e int")
    found = df.select(selection.turn_span_of_pieces(pieces(F.col("text")), F.col("s"), F.col("e")).alias("x"))
    found.limit(1).collect()
    t = time.time()
    assert [tuple(r.x) for r in found.collect()] == [(70_000, 70_003), (1, 2), (0, 1)]
    assert time.time() - t < 10  # copies of an array for each token took minutes


def test_unknown_ids_raise_and_failed_audits_hold_tables_back(spark):
    from tidewater.operators.integrity import require_known
    from tidewater.sources import files

    known = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, t string")
    assert sorted(map(tuple, require_known(rows, known, "id").collect())) == [(1, "a"), (2, "b"), (2, "c")]
    for bad in (3, None):
        with pytest.raises(Exception, match="unknown id"):
            require_known(spark.createDataFrame([(bad, "x")], "id int, t string"), known, "id").collect()
    cells = spark.createDataFrame([("m", "x", 1.25), ("n", "y", 20.0)], "m string, d string, v double")
    passed = spark.createDataFrame([("r", True)], "rule string, passed boolean")
    assert files.latex(cells, "m", "d", "v", ["x", "y"], passed).splitlines()[2] == r"n & -- & 20.0 \\"
    with pytest.raises(ValueError, match="failed audits: r"):
        files.latex(cells, "m", "d", "v", ["x", "y"], passed.withColumn("passed", ~F.col("passed")))
