"""Queries that aggregate, join, rank and report. An answer is an event: its user the example, its type the method, its day the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import hash_shard
from tidewater.operators import costs
from tidewater.operators import statistics as S
from tidewater.operators.prepare import running_sum
from tidewater.plans.context import documents
from tidewater.plans.registry import query, table

#: Answers: example, method, seed, budget, correct, score, failure.
ANSWERS = """answers AS (
  SELECT event_id, user_id AS example_id, event_type AS method, CAST(day(ts) % 3 AS INTEGER) AS seed, CAST(32 * (1 + user_id % 3) AS INTEGER) AS budget,
         user_id % 7 AS cluster, user_id % 2 AS stratum, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct, value, event_id % 9 = 0 AS failed FROM events
)"""


def answers(spark, sf_dir) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", user.alias("example_id"), F.col("event_type").alias("method"), (F.dayofmonth("ts") % 3).alias("seed"), (32 * (1 + user % 3)).cast("int").alias("budget"),
        (user % 7).alias("cluster"), (user % 2).alias("stratum"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("correct"), "value", (F.col("event_id") % 9 == 0).alias("failed"), "ts",
    )


@query(
    "shard_dedup_latest",
    f"""WITH {ANSWERS}, r AS (SELECT *, row_number() OVER (PARTITION BY example_id, method ORDER BY CAST(failed AS INTEGER), event_id DESC) AS r FROM answers)
    SELECT example_id, method, event_id, failed FROM r WHERE r = 1""",
)
def shard_dedup_latest(spark, sf_dir):
    return S.latest(answers(spark, sf_dir), ["example_id", "method"], F.col("failed"), "event_id").select("example_id", "method", "event_id", "failed")


@query(
    "cell_accuracy",
    f"""WITH {ANSWERS} SELECT method, budget, count(*) AS n, count(*) FILTER (WHERE failed) AS errors, round(avg(CASE WHEN failed THEN 0 ELSE correct END), 6) AS accuracy_e2e,
      round(avg(correct) FILTER (WHERE NOT failed), 6) AS accuracy_ok, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean_value FROM answers GROUP BY method, budget""",
)
def cell_accuracy(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("method", "budget").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("errors"), S.mean(F.when(F.col("failed"), 0.0).otherwise(F.col("correct"))).alias("accuracy_e2e"),
        S.mean(F.when(~F.col("failed"), F.col("correct"))).alias("accuracy_ok"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), S.mean(F.col("value")).alias("mean_value"),
    )


@query(
    "conditional_accuracy",
    f"""WITH {ANSWERS} SELECT a.method, round(avg(a.correct) FILTER (WHERE l.quality = 1), 6) AS kept_accuracy, round(avg(a.correct) FILTER (WHERE l.quality = 0), 6) AS lost_accuracy, count(l.doc_id) AS evaluable
    FROM answers a LEFT JOIN labels l ON l.doc_id = a.example_id GROUP BY a.method""",
)
def conditional_accuracy(spark, sf_dir):
    rows = answers(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "example_id").withColumn("there", F.lit(1)), "example_id", "left")
    return rows.groupBy("method").agg(S.mean(F.when(F.col("quality") == 1, F.col("correct"))).alias("kept_accuracy"), S.mean(F.when(F.col("quality") == 0, F.col("correct"))).alias("lost_accuracy"), F.count("there").alias("evaluable"))


@query(
    "seed_mean_dense",
    f"""WITH {ANSWERS}, one AS (SELECT example_id, method, seed, max(correct) AS correct FROM answers GROUP BY ALL), grid AS (
      SELECT * FROM (SELECT DISTINCT example_id, method FROM one), (VALUES (0), (1), (2)) s(seed)
    ) SELECT example_id, method, round(avg(coalesce(correct, 0)), 6) AS mean FROM grid LEFT JOIN one USING (example_id, method, seed) GROUP BY ALL""",
)
def seed_mean_dense(spark, sf_dir):
    one = answers(spark, sf_dir).groupBy("example_id", "method", "seed").agg(F.max("correct").alias("correct"))
    return S.seed_mean(one, spark.createDataFrame([(0,), (1,), (2,)], "seed int"), ["example_id", "method"], "correct")


@query(
    "seed_complete_only",
    f"""WITH {ANSWERS} SELECT example_id, method, round(avg(correct), 6) AS mean FROM answers GROUP BY ALL HAVING count(DISTINCT seed) = 3""",
)
def seed_complete_only(spark, sf_dir):
    return S.complete_mean(answers(spark, sf_dir), 3, ["example_id", "method"], "correct")


@query(
    "by_task_grouping_sets",
    f"""WITH {ANSWERS} SELECT method, budget, cluster AS task, CAST(grouping(cluster) AS INTEGER) AS overall, count(*) AS n, round(avg(correct), 6) AS accuracy FROM answers GROUP BY GROUPING SETS ((method, budget), (method, budget, cluster))""",
)
def by_task_grouping_sets(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumnRenamed("cluster", "task")
    method, budget, task = (F.col(c) for c in ("method", "budget", "task"))
    out = rows.groupingSets([[method, budget], [method, budget, task]], method, budget, task).agg(F.grouping("task").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"))
    return out.select("method", "budget", "task", "overall", "n", "accuracy")


@query("accuracy_rollup", f"""WITH {ANSWERS} SELECT method, count(*) AS n, round(avg(correct), 4) AS accuracy FROM answers GROUP BY ROLLUP (method)""")
def accuracy_rollup(spark, sf_dir):
    return answers(spark, sf_dir).rollup("method").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 4).alias("accuracy"))


@query("subgroup_accuracy", f"""WITH {ANSWERS} SELECT method, CASE WHEN stratum = 0 THEN 'answerable' ELSE 'abstention' END AS subgroup, round(avg(correct), 6) AS accuracy FROM answers GROUP BY ALL""")
def subgroup_accuracy(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("method", F.when(F.col("stratum") == 0, "answerable").otherwise("abstention").alias("subgroup")).agg(S.mean(F.col("correct")).alias("accuracy"))


EXAMPLES = """per AS (SELECT method, budget, example_id, cluster, stratum, avg(correct) AS x FROM answers GROUP BY ALL)"""


def per_example(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("method", "budget", "example_id", "cluster", "stratum").agg(F.avg("correct").alias("x"))


@query(
    "paired_diff_methods",
    f"""WITH {ANSWERS}, {EXAMPLES} SELECT a.method AS left_method, b.method AS right_method, a.budget, count(*) AS pairs, count(DISTINCT a.cluster) AS clusters, round(avg(a.x - b.x), 6) AS estimate
    FROM per a JOIN per b ON a.example_id = b.example_id AND a.budget = b.budget AND a.method < b.method GROUP BY ALL""",
)
def paired_diff_methods(spark, sf_dir):
    """Unordered method pairs on the same questions: the methods are few, so the self-join fans out by a constant."""
    rows = per_example(spark, sf_dir)
    left = rows.select("example_id", "budget", "cluster", F.col("method").alias("left_method"), F.col("x").alias("lx"))
    right = rows.select("example_id", "budget", F.col("method").alias("right_method"), F.col("x").alias("rx"))
    return left.join(right, ["example_id", "budget"]).where("left_method < right_method").groupBy("left_method", "right_method", "budget").agg(F.count("*").alias("pairs"), F.countDistinct("cluster").alias("clusters"), F.round(F.avg(F.col("lx") - F.col("rx")), 6).alias("estimate"))


@query(
    "paired_vs_control",
    f"""WITH {ANSWERS}, {EXAMPLES} SELECT a.method, a.budget, round(avg(a.x - c.x), 6) AS difference, count(*) AS n FROM per a JOIN per c ON c.example_id = a.example_id AND c.method = 'view' WHERE a.method <> 'view' GROUP BY ALL""",
)
def paired_vs_control(spark, sf_dir):
    rows = per_example(spark, sf_dir)
    control = rows.where("method = 'view'").select("example_id", F.col("x").alias("control"))
    return rows.where("method <> 'view'").join(control, "example_id").groupBy("method", "budget").agg(F.round(F.avg(F.col("x") - F.col("control")), 6).alias("difference"), F.count("*").alias("n"))


@query(
    "paired_full_outer_counts",
    """WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 90), r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 90)
    SELECT count(*) FILTER (WHERE r.user_id IS NULL) AS unpaired_left, count(*) FILTER (WHERE l.user_id IS NULL) AS unpaired_right, count(*) FILTER (WHERE l.user_id = r.user_id) AS paired FROM l FULL OUTER JOIN r ON l.user_id = r.user_id""",
)
def paired_full_outer_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 90")
    side = lambda kind: rows.where(F.col("event_type") == kind).select("user_id").distinct()
    both = side("click").withColumn("l", F.lit(True)).join(side("view").withColumn("r", F.lit(True)), "user_id", "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("unpaired_left"), F.count_if(F.col("l").isNull()).alias("unpaired_right"), F.count_if(F.col("l") & F.col("r")).alias("paired"))


CLUSTERS = """clusters AS (SELECT method, cluster, sum(correct) AS cluster_sum, count(*) AS cluster_n FROM answers GROUP BY ALL)"""


@query(
    "bootstrap_portable",
    f"""WITH {ANSWERS}, {CLUSTERS}, numbered AS (
      SELECT *, row_number() OVER (PARTITION BY method ORDER BY cluster) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM clusters
    ), picks AS (
      SELECT method, r, ((r * 7919 + i * 104729 + 12345) * 1103515245::BIGINT) % 2147483648 % n AS pick FROM numbered, range(200) t(r)
    ), each AS (
      SELECT p.method, p.r, sum(c.cluster_sum) / sum(c.cluster_n) AS x FROM picks p JOIN numbered c ON c.method = p.method AND c.i = p.pick GROUP BY ALL
    ), ci AS (SELECT method, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM each GROUP BY method)
    SELECT method, lo, hi, round(sum(cluster_sum) / sum(cluster_n), 6) AS estimate, count(*) AS n_clusters FROM clusters JOIN ci USING (method) GROUP BY ALL""",
)
def bootstrap_portable(spark, sf_dir):
    clusters = answers(spark, sf_dir).groupBy("method", "cluster").agg(F.sum("correct").alias("cluster_sum"), F.count("*").alias("cluster_n"))
    return S.portable_bootstrap(clusters, 200, ["method"])


@query(
    "bootstrap_stratified",
    f"""WITH {ANSWERS}, clusters AS (SELECT method, stratum, cluster, sum(correct) AS cluster_sum, count(*) AS cluster_n FROM answers GROUP BY ALL
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY method, stratum ORDER BY cluster) - 1 AS i, count(*) OVER (PARTITION BY method, stratum) AS n, dense_rank() OVER (PARTITION BY method ORDER BY stratum) AS s FROM clusters
    ), picks AS (
      SELECT method, stratum, r, ((r * 7919 + (i + s * 15485863) * 104729 + 12345) % 2147483648 * 1103515245::BIGINT) % 2147483648 % n AS pick FROM numbered, range(200) t(r)
    ), each AS (
      SELECT p.method, p.r, sum(c.cluster_sum) / sum(c.cluster_n) AS x FROM picks p JOIN numbered c ON c.method = p.method AND c.stratum = p.stratum AND c.i = p.pick GROUP BY ALL
    ), ci AS (SELECT method, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM each GROUP BY method)
    SELECT method, lo, hi, round(sum(cluster_sum) / sum(cluster_n), 6) AS estimate, count(*) AS n_clusters FROM clusters JOIN ci USING (method) GROUP BY ALL""",
)
def bootstrap_stratified(spark, sf_dir):
    """Clusters drawn within strata by a rule that every engine computes alike."""
    clusters = answers(spark, sf_dir).groupBy("method", "stratum", "cluster").agg(F.sum("correct").alias("cluster_sum"), F.count("*").alias("cluster_n"))
    return S.stratified_bootstrap(clusters, 200, ["method"])


@query("bootstrap_numpy")
def bootstrap_numpy(spark, sf_dir):
    """Clusters resampled within strata by numpy's generator; tests hold it against a direct loop."""
    clusters = answers(spark, sf_dir).groupBy("method", "stratum", "cluster").agg(F.sum("correct").alias("cluster_sum"), F.count("*").alias("cluster_n"))
    return S.cluster_bootstrap(clusters, ["method"])


@query(
    "pareto_frontier",
    """WITH x AS (SELECT c_mktsegment, c_custkey, c_acctbal AS y, c_custkey % 97 AS x FROM customer), m AS (
      SELECT *, max(y) OVER (PARTITION BY c_mktsegment ORDER BY x, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM x
    ) SELECT c_mktsegment, x, y FROM m WHERE best IS NULL OR y > best""",
)
def pareto_frontier(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_custkey") % 97).alias("x"), F.col("c_acctbal").alias("y"))
    return S.pareto(rows, "x", "y", ["c_mktsegment"])


@query(
    "latency_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type""",
)
def latency_quantiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), S.mean(F.col("value")).alias("mean"), F.count("*").alias("n"))


@query(
    "serving_cost",
    """SELECT event_type, round(sum(round(value * 0.0001 + value * (CASE WHEN user_id % 3 = 0 THEN 0.13402284 ELSE 0.853624312 END) / 3600, 8)) FILTER (WHERE event_id % 10 <> 0), 4) AS total, count(*) FILTER (WHERE event_id % 10 = 0) AS unknown FROM events GROUP BY event_type""",
)
def serving_cost(spark, sf_dir):
    hourly = F.when(F.col("user_id") % 3 == 0, 0.13402284).otherwise(0.853624312)
    cost = costs.serving_cost(F.col("value") * 0.0001, F.when(F.col("event_id") % 10 != 0, F.col("value")), hourly)
    return table(spark, sf_dir, "events").withColumn("cost", cost).groupBy("event_type").agg(F.round(F.sum("cost"), 4).alias("total"), F.count_if(F.col("cost").isNull()).alias("unknown"))


#: Hourly prices by machine, of this query alone.
HOURLY = {"small": 0.41, "medium": 0.93, "large": 3.19}


@query(
    "api_cost_tiers",
    """WITH p(model, i, o, thr, il, ol, th) AS (VALUES ('tiered', 1.4, 9.5, 150000, 3.1, 13.0, NULL), ('flat', 0.7, 2.2, NULL, NULL, NULL, NULL), ('thinking', 0.45, 1.3, NULL, NULL, NULL, 2.8)), c AS (
      SELECT o_orderkey, (['tiered', 'flat', 'thinking', 'unlisted'])[1 + o_orderkey % 4] AS model, CAST(floor(o_totalprice) AS BIGINT) AS n, o_custkey AS m, o_orderkey % 100 AS t FROM orders
    ), r AS (SELECT *, CASE WHEN coalesce(n > thr, false) THEN il ELSE i END AS ri, CASE WHEN coalesce(n > thr, false) THEN ol ELSE o END AS ro FROM c LEFT JOIN p USING (model))
    SELECT o_orderkey, model, round((n * ri + m * ro + t * coalesce(th, ro))::DOUBLE / 1e6, 8) AS cost FROM r""",
)
def api_cost_tiers(spark, sf_dir):
    """Calls at a tiered, a flat and a thinking rate; a model without a price costs null."""
    prices = [("tiered", 1.4, 9.5, 150_000, 3.1, 13.0, None), ("flat", 0.7, 2.2, None, None, None, None), ("thinking", 0.45, 1.3, None, None, None, 2.8)]
    model = F.get(F.array(*map(F.lit, ("tiered", "flat", "thinking", "unlisted"))), (F.col("o_orderkey") % 4).cast("int"))
    calls = table(spark, sf_dir, "orders").select("o_orderkey", model.alias("model"), F.floor("o_totalprice").alias("input_tokens"), F.col("o_custkey").alias("output_tokens"), (F.col("o_orderkey") % 100).alias("thought_tokens"))
    return costs.api_cost(calls, costs.model_prices(spark, prices)).select("o_orderkey", "model", "cost")


@query(
    "gpu_and_selection_cost",
    """WITH x AS (SELECT o_orderkey, (['small', 'medium', 'large', 'other'])[1 + o_orderkey % 4] AS kind, (['head', 'dense', 'bm25', 'provence'])[1 + o_custkey % 4] AS method, o_totalprice / 100 AS s FROM orders), y AS (
      SELECT *, coalesce(CASE kind WHEN 'small' THEN 0.41::DOUBLE WHEN 'medium' THEN 0.93 WHEN 'large' THEN 3.19 END, 0) * s / 3600 AS gpu FROM x)
    SELECT o_orderkey, round(gpu, 6) AS gpu_cost, round(CASE WHEN o_orderkey % 10 = 0 THEN 1.5 WHEN method IN ('head', 'bm25') THEN NULL ELSE gpu END, 6) AS selection_cost FROM y""",
)
def gpu_and_selection_cost(spark, sf_dir):
    at = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    gpu = costs.gpu_cost(at(("small", "medium", "large", "other"), F.col("o_orderkey") % 4), F.col("o_totalprice") / 100, HOURLY)
    reported = F.when(F.col("o_orderkey") % 10 == 0, 1.5)
    cost = costs.selection_cost(reported, F.lit("gpu"), at(("head", "dense", "bm25", "provence"), F.col("o_custkey") % 4), F.lit(False), F.lit(None).cast("double"), gpu)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(gpu, 6).alias("gpu_cost"), F.round(cost, 6).alias("selection_cost"))


@query(
    "resource_metrics",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS s, CAST(l_extendedprice AS INTEGER) AS n, (['32', 'inf', '16', 'Full'])[1 + l_orderkey % 4] AS lab FROM lineitem), y AS (
      SELECT *, CASE WHEN lower(lab) NOT IN ('inf', 'none', 'full') THEN CAST(lab AS INTEGER) END AS b FROM (SELECT *, lab AS l2 FROM x) WHERE lower(lab) NOT IN ('inf','full')
      UNION ALL SELECT *, NULL AS b FROM (SELECT *, lab AS l2 FROM x) WHERE lower(lab) IN ('inf', 'full'))
    SELECT coalesce(CAST(b AS VARCHAR), 'inf') AS budget, count(*) AS rows_, CAST(sum(CASE WHEN b IS NOT NULL THEN greatest(b - s, 0) END) AS BIGINT) AS unused, round(avg(s::DOUBLE / nullif(n, 0)), 6) AS compression, round(avg(s::DOUBLE / b), 6) AS utilisation FROM y GROUP BY 1""",
)
def resource_metrics(spark, sf_dir):
    label = F.get(F.array(*map(F.lit, ("32", "inf", "16", "Full"))), (F.col("l_orderkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.round("l_quantity").cast("int").alias("s"), F.bround("l_extendedprice").cast("int").alias("n"), costs.budget_from_label(label).alias("b"))
    return rows.groupBy(costs.budget_label(F.col("b")).alias("budget")).agg(
        F.count("*").alias("rows_"), F.sum(F.when(F.col("b").isNotNull(), costs.unused(F.col("b"), F.col("s")))).alias("unused"), F.round(F.avg(costs.compression(F.col("s"), F.col("n"))), 6).alias("compression"), F.round(F.avg(F.col("s") / F.col("b")), 6).alias("utilisation")
    )


@query(
    "stratified_round_robin",
    """WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS t FROM documents) SELECT doc_id, lang FROM x ORDER BY t, lang LIMIT 30""",
)
def stratified_round_robin(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang")
    return S.round_robin(rows, "lang", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 30).select("doc_id", "lang")


@query(
    "hash_shards",
    """WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)
    SELECT doc_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(16), lambda k: CAST('0x' || h[4 * k + 1 : 4 * k + 4] AS BIGINT))), lambda a, b: (a * 65536 + b) % 7) AS BIGINT) AS shard FROM h""",
)
def hash_shards(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", hash_shard(F.col("doc_id").cast("string"), 7).alias("shard"))


@query(
    "hash_sample_per_cell",
    """WITH x AS (SELECT d.doc_id, d.source, l.quality, row_number() OVER (PARTITION BY source, quality ORDER BY sha256(CAST(d.doc_id AS VARCHAR))) AS r FROM documents d JOIN labels l USING (doc_id)) SELECT doc_id, source, quality FROM x WHERE r <= 2""",
)
def hash_sample_per_cell(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    order = Window.partitionBy("source", "quality").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 2").select("doc_id", "source", "quality")


@query("stride_shards", """SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS shard FROM documents""")
def stride_shards(spark, sf_dir):
    """Each source's rows in turn, numbered by blocks, so that no task has to count a whole source."""
    rows = running_sum(documents(spark, sf_dir).select("source", "doc_id", F.lit(1).alias("one")), "source", "doc_id", [], "one")
    return rows.select("doc_id", ((F.col("running") - 1) % 4).cast("long").alias("shard"))


@query(
    "cohort_matrix",
    """WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+$')) AS source_tokens FROM documents)
    SELECT doc_id, method, CAST(budget AS INTEGER) AS budget, CAST(seed AS INTEGER) AS seed FROM t, (VALUES ('head'), ('bm25')) m(method), (VALUES (64), (256)) b(budget), (VALUES (0), (1), (2)) s(seed) WHERE source_tokens > budget""",
)
def cohort_matrix(spark, sf_dir):
    """The work matrix: the protocol's dimensions are constants, so rows are exploded in place."""
    from tidewater.functions.tokens import count

    rows = documents(spark, sf_dir).select("doc_id", count(F.col("text")).alias("source_tokens"))
    for name, values in (("method", ("head", "bm25")), ("budget", (64, 256)), ("seed", (0, 1, 2))):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.where("source_tokens > budget").select("doc_id", "method", "budget", "seed")


@query("resume_anti", """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)""")
def resume_anti(spark, sf_dir):
    """What is still to do: ids without a success (failures are retried)."""
    return documents(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id", "left_anti")


@query("common_cohort_semi", """SELECT l.quality, count(*) AS n, round(avg(l.toxic), 6) AS toxic FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 2000) GROUP BY l.quality""")
def common_cohort_semi(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).where("n_chars > 2000").select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("quality").agg(F.count("*").alias("n"), S.mean(F.col("toxic")).alias("toxic"))


@query("unknown_ids_anti", """SELECT count(*) AS unknown FROM (SELECT DISTINCT user_id FROM events) e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id)""")
def unknown_ids_anti(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return ids.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("unknown"))


@query(
    "report_latex",
    f"""WITH {ANSWERS}, cells AS (SELECT method, budget, 100 * avg(correct) AS v, count(DISTINCT seed) AS seeds FROM answers GROUP BY ALL), wide AS (
      SELECT method, max(v) FILTER (WHERE budget = 32 AND seeds = 3) AS x, max(v) FILTER (WHERE budget = 64 AND seeds = 3) AS y, max(v) FILTER (WHERE budget = 128 AND seeds = 3) AS z FROM cells GROUP BY method
    ) SELECT method, concat_ws(' & ', method, coalesce(printf('%.1f', x), '--'), coalesce(printf('%.1f', y), '--'), coalesce(printf('%.1f', z), '--')) || ' \\\\' AS line FROM wide""",
)
def report_latex(spark, sf_dir):
    """Lines of a table of accuracies; cells without every seed, and budgets nobody ran, are dashes."""
    from tidewater.sources.files import latex_rows

    cells = answers(spark, sf_dir).groupBy("method", "budget").agg((100 * F.avg("correct")).alias("v"), F.countDistinct("seed").alias("seeds")).where("seeds = 3")
    return latex_rows(cells, "method", "budget", "v", [32, 64, 128])


@query(
    "known_ids",
    """SELECT l.doc_id, l.quality FROM labels l SEMI JOIN documents d USING (doc_id)""",
)
def known_ids(spark, sf_dir):
    """Labels of documents; one of a document that isn't there would raise."""
    from tidewater.operators.integrity import require_known

    return require_known(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents"), "doc_id")


@query("report_pivot", f"""WITH {ANSWERS} SELECT method, round(avg(correct) FILTER (WHERE budget = 32), 4) AS "32", round(avg(correct) FILTER (WHERE budget = 64), 4) AS "64", round(avg(correct) FILTER (WHERE budget = 96), 4) AS "96" FROM answers GROUP BY method""")
def report_pivot(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("method").pivot("budget", [32, 64, 96]).agg(F.round(F.avg("correct"), 4))


@query(
    "report_markdown",
    f"""WITH {ANSWERS} SELECT '| ' || method || ' | ' || budget || ' | ' || count(*) || ' |' AS line FROM answers GROUP BY method, budget""",
)
def report_markdown(spark, sf_dir):
    rows = answers(spark, sf_dir).groupBy("method", "budget").agg(F.count("*").alias("n"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "method", F.col("budget").cast("string"), F.col("n").cast("string")), F.lit(" |")).alias("line"))


@query("dataset_statistics", """SELECT lang, count(*) AS kept, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 4) AS mean, count(*) FILTER (WHERE n_chars < 500) AS below FROM documents GROUP BY lang""")
def dataset_statistics(spark, sf_dir):
    n = F.col("n_chars")
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("kept"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean"), F.count_if(n < 500).alias("below"))


@query(
    "latency_override",
    """WITH old AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), fresh AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY 1)
    SELECT u.user_id, round(coalesce(f.v, o.v), 6) AS latency FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN old o USING (user_id) LEFT JOIN fresh f USING (user_id)""",
)
def latency_override(spark, sf_dir):
    """Two left joins: a fresh timing wins over the first one."""
    rows = table(spark, sf_dir, "events")
    old = rows.where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("old"))
    fresh = rows.where("event_type = 'click' AND user_id % 3 = 0").groupBy("user_id").agg(F.max("value").alias("fresh"))
    out = rows.select("user_id").distinct().join(old, "user_id", "left").join(fresh, "user_id", "left")
    return out.select("user_id", F.round(F.coalesce("fresh", "old"), 6).alias("latency"))


@query(
    "judgment_join",
    """WITH r AS (SELECT DISTINCT text FROM documents), j AS (SELECT md5(text) AS key, length(text) % 2 AS correct FROM r WHERE length(text) % 5 <> 0)
    SELECT d.doc_id, coalesce(j.correct, 0)::BIGINT AS correct, j.key IS NULL AS missing FROM documents d LEFT JOIN j ON j.key = md5(d.text)""",
)
def judgment_join(spark, sf_dir):
    """Many links to one judgment by content hash; a missing one counts as zero and is marked."""
    links = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("key"), F.length("text").alias("n"))
    judged = links.where("n % 5 <> 0").select("key", (F.col("n") % 2).cast("long").alias("correct")).distinct()
    return links.join(judged, "key", "left").select("doc_id", F.coalesce("correct", F.lit(0)).alias("correct"), F.col("correct").isNull().alias("missing"))


@query(
    "cohort_scores",
    f"""WITH {ANSWERS} SELECT method, round(avg(CASE WHEN failed THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS success_rate, round(avg(value) FILTER (WHERE NOT failed), 6) AS mean_score,
      round(avg(CASE WHEN value >= 95 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE NOT failed), 6) AS perfect_rate FROM answers GROUP BY method""",
)
def cohort_scores(spark, sf_dir):
    scored = ~F.col("failed")
    return answers(spark, sf_dir).groupBy("method").agg(S.mean(scored.cast("double")).alias("success_rate"), S.mean(F.when(scored, F.col("value"))).alias("mean_score"), S.mean(F.when(scored, (F.col("value") >= 95).cast("double"))).alias("perfect_rate"))


@query("rerun_set", f"""WITH {ANSWERS} SELECT doc_id, sha256(text) AS prompt_sha256 FROM documents WHERE doc_id IN (SELECT example_id FROM answers WHERE failed OR value < 1)""")
def rerun_set(spark, sf_dir):
    """Prompts of the examples that failed or scored nothing."""
    failed = answers(spark, sf_dir).where("failed OR value < 1").select(F.col("example_id").alias("doc_id"))
    return documents(spark, sf_dir).join(failed, "doc_id", "left_semi").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("prompt_sha256"))


@query(
    "topk_first_and_latest",
    """WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS d FROM events) SELECT user_id, event_id, a <= 3 AS first_three FROM x WHERE a <= 3 OR d <= 3""",
)
def topk_first_and_latest(spark, sf_dir):
    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("a"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("d"))
    return rows.where("a <= 3 OR d <= 3").select("user_id", "event_id", (F.col("a") <= 3).alias("first_three"))


@query(
    "needle_matrix",
    """SELECT n_name AS needle, r_name AS test, depth, CAST(n_nationkey % 3 AS BIGINT) AS question FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) d(depth)""",
)
def needle_matrix(spark, sf_dir):
    """Needles, their tests and the depths at which they are placed: nested lists exploded in place."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.withColumn("depth", F.explode(F.array(F.lit(0.25), F.lit(0.75)))).select(F.col("n_name").alias("needle"), F.col("r_name").alias("test"), "depth", (F.col("n_nationkey") % 3).cast("long").alias("question"))
