"""Runs that are taken up again, stores that are looked up, and audits of what they keep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewater.operators import constraints as C
from tidewater.operators import layouts, shards
from tidewater.operators.layout import fresh_folder, written
from tidewater.plans.registry import query, table
from tidewater.sources import indexed, judgments
from tidewater.sources.clients import echo_client
from tidewater.streaming.runs import Run

LINE = "method string, example_id long, text string, error string"
KEYS = ["method", "example_id"]


@query(
    "indexed_selections",
    """WITH lines AS (
      SELECT o_orderpriority AS method, o_orderkey AS example_id, o_orderstatus || ':' || o_custkey AS text, NULL AS error, o_custkey FROM orders WHERE o_orderkey % 11 > 0
      UNION ALL SELECT o_orderpriority, o_orderkey, o_orderstatus || ':' || o_custkey, NULL, o_custkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 11 > 0
      UNION ALL SELECT o_orderpriority, o_orderkey, NULL, 'timeout', o_custkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0
    ), first AS (SELECT *, row_number() OVER (PARTITION BY method, example_id ORDER BY error IS NOT NULL) AS r FROM lines)
    SELECT method, example_id, text, error IS NOT NULL AS failed FROM first WHERE r = 1 AND o_custkey % 100 = 1""",
)
def indexed_selections(spark, sf_dir):
    """Selections of some customers' questions, read by an index of where their lines lie and not by scanning the lines."""
    orders = table(spark, sf_dir, "orders")
    good = orders.select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("example_id"), F.concat_ws(":", "o_orderstatus", F.col("o_custkey").cast("string")).alias("text"), F.lit(None).cast("string").alias("error")).where("example_id % 11 > 0")
    bad = orders.where("o_orderkey % 7 = 0 OR o_orderkey % 11 = 0").select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("example_id"), F.lit(None).cast("string").alias("text"), F.lit("timeout").alias("error"))
    lines = fresh_folder(spark, "lines")
    bad.unionByName(good).unionByName(good.where("example_id % 5 = 0")).write.json(lines)
    found = indexed.index_lines(spark, lines, LINE, KEYS, ["method", "example_id", "text"], F.col("error").isNotNull())
    index = indexed.save_index(indexed.chosen_entries(found, KEYS), fresh_folder(spark, "index"), KEYS)
    asked = orders.where("o_custkey % 100 = 1").select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("example_id"))
    rows = indexed.read_entries(index.join(asked, KEYS, "left_semi"), lines, LINE)
    return rows.select("method", "example_id", "text", F.col("error").isNotNull().alias("failed"))


def unsteady_client(prompt: str, seed: int) -> tuple[str, int, int, str]:
    """The stand-in, failing for every third seed."""
    if seed % 3 == 0:
        raise TimeoutError("no answer")
    return echo_client(prompt, seed)


@query(
    "resumable_run",
    r"""WITH tasks AS (SELECT doc_id, 'Which source is it?' || chr(10) || coalesce(source, '') || ' ' || coalesce(lang, '') AS prompt FROM documents
    ), tries AS (SELECT doc_id, prompt, t, doc_id % 3 = 0 AND t = 0 AS failed FROM tasks, range(2) r(t)
    ), made AS (SELECT *, coalesce(bool_or(NOT failed) OVER (PARTITION BY doc_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had FROM tries)
    SELECT CAST(doc_id AS VARCHAR) AS key, count(*) AS tries, max(CASE WHEN NOT failed THEN trim(split_part(prompt, chr(10), 2)) END) AS output,
           max(CASE WHEN NOT failed THEN len(regexp_extract_all(prompt, '\S+')) END) AS prompt_tokens FROM made WHERE NOT had GROUP BY doc_id""",
)
def resumable_run(spark, sf_dir):
    """A run that failed for some tasks and is taken up twice: what had no answer is asked again, and nothing is asked after that."""
    prompt = F.concat(F.lit("Which source is it?\n"), F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit("")))
    tasks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), prompt.alias("prompt"), F.col("doc_id").alias("seed"), F.lit("reader").alias("category"), F.lit(0.001).alias("amount"))
    folder = fresh_folder(spark, "run")
    for client in (unsteady_client, echo_client, echo_client):
        Run(folder, "protocol 1", client).batch(tasks)
    receipts = Run(folder, "protocol 1").receipts(spark)
    answered = F.when(F.col("error").isNull(), F.col("output"))
    return receipts.groupBy("key").agg(F.count("*").alias("tries"), F.max(answered).alias("output"), F.max(F.when(F.col("error").isNull(), F.col("prompt_tokens"))).alias("prompt_tokens"))


@query(
    "judgment_store",
    """WITH kept AS (
      SELECT sha256(coalesce(text, '')) AS request, arg_max({'model': CASE WHEN doc_id % 10 = 0 THEN 'judge-1' ELSE 'judge-2' END, 'used': CASE WHEN doc_id % 7 > 0 THEN 10 END, 'cost': doc_id / 1000}, doc_id) AS r FROM documents WHERE doc_id % 3 > 0 GROUP BY 1
    ), asked AS (
      SELECT doc_id, r, CASE WHEN r IS NULL THEN 'miss' WHEN r.model <> 'judge-2' THEN 'stale_model' WHEN r.used IS NULL THEN 'missing_usage' ELSE 'hit' END AS status FROM documents LEFT JOIN kept ON request = sha256(coalesce(text, ''))
    ) SELECT doc_id, status, CASE WHEN status = 'hit' THEN r.cost::DOUBLE END AS cost FROM asked""",
)
def judgment_store(spark, sf_dir):
    """Requests against a bucketed store of judgments: texts that repeat share one, and unusable ones are told apart."""
    model, body = F.lit("judge-2"), F.coalesce("text", F.lit(""))
    asked = table(spark, sf_dir, "documents").select("doc_id", model.alias("model"), judgments.request_digest(model, body).alias("request_sha256"))
    name = f"judgments_{uuid.uuid4().hex}"
    judgments.open_store(spark, name, fresh_folder(spark, "judgments"), 8)
    by = F.when(F.col("doc_id") % 10 == 0, "judge-1").otherwise("judge-2")
    used = F.when(F.col("doc_id") % 7 > 0, F.lit(10).cast("long"))
    given = asked.where("doc_id % 3 > 0").select("request_sha256", by.alias("model"), F.lit("yes").alias("verdict"), used.alias("prompt_tokens"), F.lit(1).cast("long").alias("output_tokens"), (F.col("doc_id") / 1000).alias("cost"))
    judgments.add_judgments(name, given, 8)
    found = judgments.look_up(asked, name)
    return found.select("doc_id", "status", F.when(F.col("status") == "hit", F.col("cost")).alias("cost"))


@query(
    "shard_coverage",
    """WITH held AS (
      SELECT o_custkey % 4 AS shard, o_orderkey AS n FROM orders WHERE o_orderkey % 97 > 0
      UNION ALL SELECT (o_custkey + 1) % 4, o_orderkey FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey % 97 > 0
      UNION ALL SELECT o_custkey % 4, o_orderkey + 100000000 FROM orders WHERE o_orderkey % 1000 = 1
    ), e AS (SELECT o_orderkey // 32768 + 1 AS bucket, o_orderkey AS n FROM orders
    ), h AS (SELECT n // 32768 + 1 AS bucket, n, count(DISTINCT shard) AS shards FROM held GROUP BY n
    ), x AS (SELECT coalesce(e.bucket, h.bucket) AS bucket, e.n AS want, h.n AS have, coalesce(shards, 0) AS shards FROM e FULL OUTER JOIN h USING (n))
    SELECT bucket, count(want) AS expected, count(have) AS covered, CAST(sum(greatest(shards - 1, 0)) AS BIGINT) AS overlaps, count(*) FILTER (WHERE have IS NULL) AS gaps, count(*) FILTER (WHERE want IS NULL) AS strays FROM x GROUP BY bucket""",
)
def shard_coverage(spark, sf_dir):
    """Shards of which some share rows, some leave rows out and some have rows that nobody asked for."""
    orders = table(spark, sf_dir, "orders")
    held = orders.where("o_orderkey % 97 > 0").select((F.col("o_custkey") % 4).alias("shard"), F.col("o_orderkey").alias("n"))
    twice = orders.where("o_orderkey % 101 = 0 AND o_orderkey % 97 > 0").select(((F.col("o_custkey") + 1) % 4).alias("shard"), F.col("o_orderkey").alias("n"))
    stray = orders.where("o_orderkey % 1000 = 1").select((F.col("o_custkey") % 4).alias("shard"), (F.col("o_orderkey") + 100_000_000).alias("n"))
    return shards.shard_coverage(held.unionAll(twice).unionAll(stray), orders.select(F.col("o_orderkey").alias("n")), "shard", "n")


@query(
    "rerun_digests",
    """WITH a AS (SELECT event_type AS method, user_id, round(sum(value), 6) AS total FROM events GROUP BY ALL
    ), b AS (SELECT method, user_id, round(total + CASE WHEN method = 'click' AND user_id = 3 THEN 1 ELSE 0 END, 6) AS total FROM a)
    SELECT a.method, count(*) AS n_first, count(b.user_id) AS n_second, bool_and(a.total = b.total) AS same FROM a JOIN b USING (method, user_id) GROUP BY a.method""",
)
def rerun_digests(spark, sf_dir):
    """Two runs of one aggregation over other partitions, the second with one value changed: cells compare by digests that no order changes."""
    events = table(spark, sf_dir, "events")

    def run(rows, label, extra):
        totals = rows.groupBy(F.col("event_type").alias("method"), "user_id").agg(F.sum("value").alias("total"))
        return written(totals.select("method", "user_id", F.round(F.col("total") + extra, 6).cast("decimal(20,6)").alias("total")), label)

    planted = F.when((F.col("method") == "click") & (F.col("user_id") == 3), 1.0).otherwise(0.0)
    first, second = run(events, "first", F.lit(0.0)), run(events.repartition(7, "value"), "second", planted)
    return shards.reruns_agree(first, second, ["method"], ["user_id", "total"])


#: Rules of the audit: conditions are such that both engines read them.
ROW_RULES = {
    "region": {"region named": "length(r_name) > 0"},
    "nation": {"nation named": "length(n_name) > 0", "nation key positive": "n_nationkey > 0"},
    "customer": {"customer solvent": "c_acctbal >= 0", "customer segment known": "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')", "customer named by key": "c_name IS NOT NULL"},
    "supplier": {"supplier solvent": "s_acctbal >= 0", "supplier named": "length(s_name) > 0"},
    "part": {"part size in range": "p_size BETWEEN 1 AND 50", "part priced": "p_retailprice > 0", "part branded": "p_brand LIKE 'Brand%'"},
    "orders": {"order priced": "o_totalprice > 0", "order status known": "o_orderstatus IN ('F', 'O', 'P')", "order dated": "o_orderdate IS NOT NULL", "order is large": "o_totalprice >= 1000"},
    "lineitem": {"discount in range": "l_discount BETWEEN 0 AND 0.1", "tax in range": "l_tax BETWEEN 0 AND 0.08", "quantity in range": "l_quantity BETWEEN 1 AND 50", "returned or not": "l_returnflag IN ('A', 'N', 'R')", "price covers quantity": "l_extendedprice >= l_quantity"},
    "events": {"event typed": "event_type IS NOT NULL", "event value positive": "value > 0", "event has properties": "props IS NOT NULL"},
    "documents": {"document has text": "length(text) > 0", "document length kept": "n_chars = length(text)", "document has a source": "source IS NOT NULL"},
    "labels": {"quality is binary": "quality IN (0, 1)", "toxicity is binary": "toxic IN (0, 1)"},
}
UNIQUE_RULES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}
FOREIGN_RULES = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
COUNT_RULES = [("region", 5, 5, "r_regionkey >= 0"), ("nation", 26, 30, "n_nationkey >= 0"), ("events", 1, 0, "value > 99.9")]
SAME_RULES = [("labels", "documents", "quality >= 0", "doc_id >= 0"), ("orders", "orders", "o_orderstatus = 'F'", "o_orderstatus <> 'O'")]


def audit_sql() -> str:
    out = [f"SELECT '{n}' AS rule, 'row' AS kind, count(*) AS checked, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failed FROM {t}" for t, rules in ROW_RULES.items() for n, c in rules.items()]
    out += [f"SELECT '{t} {k} unique', 'unique', coalesce(sum(n), 0), coalesce(sum(n) FILTER (WHERE k IS NULL OR n > 1), 0) FROM (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY 1)" for t, k in UNIQUE_RULES.items()]
    out += [f"SELECT '{t} {k} known', 'foreign', count({k}), count({k}) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {o} WHERE {o}.{j} = {t}.{k})) FROM {t}" for t, k, o, j in FOREIGN_RULES]
    out += [f"SELECT '{t} count', 'count', count(*), greatest({a} - count(*), 0) + greatest(count(*) - {b}, 0) FROM {t} WHERE {c}" for t, a, b, c in COUNT_RULES]
    out += [f"SELECT '{t} as many as {o}', 'same', a, abs(a - b) FROM (SELECT count(*) AS a FROM {t} WHERE {c}), (SELECT count(*) AS b FROM {o} WHERE {d})" for t, o, c, d in SAME_RULES]
    return f"SELECT rule, kind, CAST(checked AS BIGINT) AS checked, CAST(failed AS BIGINT) AS failed, failed = 0 AS passed FROM ({' UNION ALL '.join(out)})"


def audit_rules() -> list[C.Rule]:
    rules: list[C.Rule] = [C.Row(n, t, F.expr(c)) for t, each in ROW_RULES.items() for n, c in each.items()]
    rules += [C.Unique(f"{t} {k} unique", t, k) for t, k in UNIQUE_RULES.items()]
    rules += [C.Foreign(f"{t} {k} known", t, k, o, j) for t, k, o, j in FOREIGN_RULES]
    rules += [C.Count(f"{t} count", t, a, b, F.expr(c)) for t, a, b, c in COUNT_RULES]
    return rules + [C.Same(f"{t} as many as {o}", t, o, F.expr(c), F.expr(d)) for t, o, c, d in SAME_RULES]


@query("constraint_audit", audit_sql())
def constraint_audit(spark, sf_dir):
    """Over forty rules on rows, keys, references and counts; each table is scanned once."""
    rules = audit_rules()
    names = {r.table for r in rules} | {r.other for r in rules if isinstance(r, C.Foreign | C.Same)}
    return C.audit({t: table(spark, sf_dir, t) for t in sorted(names)}, rules)


@query(
    "layout_store",
    r"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 25 = 4 THEN coalesce(text, '') || ' changed' ELSE coalesce(text, '') END AS text FROM documents
    ), first AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents
    ), p AS (SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$') AS p FROM now)
    SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM first WHERE first.text = p.text) THEN 'first' ELSE 'second' END AS made, CAST(len(p) AS INTEGER) AS n_tokens,
           CAST(CASE WHEN len(p) = 0 THEN 0 ELSE greatest(CAST(ceil((len(p) - 64) / 48.0) AS BIGINT), 0) + 1 END AS INTEGER) AS n_chunks,
           CASE WHEN len(p) > 0 THEN length(array_to_string(p[1 : 64], '')) END AS first_end FROM p""",
)
def layout_store(spark, sf_dir):
    """Layouts of all texts, made once; after some texts have changed, only these are laid out anew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    now = docs.withColumn("text", F.when(F.col("doc_id") % 25 == 4, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    name = f"layouts_{uuid.uuid4().hex}"
    layouts.open_layouts(spark, name, fresh_folder(spark, "layouts"), 8)
    layouts.lay_out(docs, name, "first", buckets=8)
    layouts.lay_out(now, name, "second", buckets=8)
    found = layouts.with_layout(now, name).withColumn("chunks", layouts.chunk_spans(F.col("ends")))
    return found.select("doc_id", "made", F.size("ends").alias("n_tokens"), F.size("chunks").alias("n_chunks"), F.get("chunks", F.lit(0))["char_end"].cast("long").alias("first_end"))
