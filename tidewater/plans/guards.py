"""Queries over guards: claims of stored selections, budgets and windows, annotations, paid calls, paired intervals."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidewater.functions import spans, tokens
from tidewater.operators import byte_tokens, costs, selection, spend
from tidewater.operators import statistics as S
from tidewater.operators.evidence import planted, span_hits
from tidewater.operators.packing import pack_concat
from tidewater.operators.ranking import dense_topk, ranked
from tidewater.plans.context import PACKED, documents, ranking
from tidewater.plans.evidence import FACTS
from tidewater.plans.registry import BUDGETS, TOK, query, table

PRICE_FILE = os.path.join(os.path.dirname(os.path.dirname(__file__)), "prices", "2026_09.json")


def pick(values, key):
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


@query(
    "claimed_renderings",
    f"""WITH {PACKED}, both_ways AS (
      SELECT doc_id, budget, count(*) AS n, string_agg(chunk_text, chr(10) ORDER BY rank) AS by_rank, string_agg(chunk_text, chr(10) ORDER BY chunk_ord) AS by_source, list(chunk_ord) AS ords FROM packed GROUP BY doc_id, budget
    ), stored AS (
      SELECT *, (budget // 64 + doc_id) % 4 = 3 AS twice, CASE (budget // 64 + doc_id) % 4 WHEN 0 THEN by_rank WHEN 1 THEN by_source WHEN 2 THEN replace(by_source, 'a', 'b') ELSE by_rank END AS stored FROM both_ways
    ) SELECT doc_id, CAST(budget AS INTEGER) AS budget, CASE WHEN twice THEN 'repeated' WHEN stored IN (by_rank, by_source) THEN 'ok' ELSE 'mismatch' END AS status FROM stored""",
)
def claimed_renderings(spark, sf_dir):
    """Stored texts, some of them altered and some with a chunk claimed twice, against the renderings of their chunks."""
    chunk = F.struct("rank", "chunk_ord", "chunk_text")
    rows = pack_concat(ranking(spark, sf_dir, True), BUDGETS).groupBy("doc_id", "budget").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    rank, source = selection.renderings(F.col("chunks"))
    kind = (F.floor(F.col("budget") / 64) + F.col("doc_id")) % 4
    stored = F.when(kind == 1, source).when(kind == 2, F.replace(source, F.lit("a"), F.lit("b"))).otherwise(rank)
    claimed = F.when(kind == 3, F.concat("chunks", F.slice("chunks", 1, 1))).otherwise(F.col("chunks"))
    return rows.select("doc_id", "budget", selection.claim_status(stored, claimed).alias("status"))


@query(
    "union_validation",
    f"""WITH {TOK}, x AS (
      SELECT doc_id, p, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 2 THEN [[5, 20], [20, 40]] ELSE [[5, 20], [30, 40]] END AS claimed FROM tok WHERE len(p) >= 40
    ), r AS (SELECT *, array_to_string(list_transform(claimed, lambda c: array_to_string(p[c[1] + 1 : c[2]], '')), chr(10)) AS rendered FROM x
    ), t AS (SELECT *, CASE kind WHEN 1 THEN replace(rendered, 'e', 'x') ELSE rendered END AS stored FROM r)
    SELECT doc_id, CASE WHEN stored <> rendered THEN 'text' WHEN claimed[2][1] <= claimed[1][2] THEN 'spans' ELSE 'ok' END AS status FROM t""",
)
def union_validation(spark, sf_dir):
    """Spans with their text: right ones, ones with another text, and ones that touch and should have been merged."""
    rows = documents(spark, sf_dir).select("doc_id", tokens.pieces(F.col("text")).alias("p")).where("size(p) >= 40")
    at = lambda *pairs: F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in pairs))
    kind = F.pmod("doc_id", F.lit(3))
    rows = rows.withColumn("claimed", F.when(kind == 2, at((5, 20), (20, 40))).otherwise(at((5, 20), (30, 40))))
    text = selection.render_spans(F.col("p"), F.col("claimed"))
    text = F.when(kind == 1, F.replace(text, F.lit("e"), F.lit("x"))).otherwise(text)
    return rows.select("doc_id", selection.union_status(F.col("p"), text, F.col("claimed")).alias("status"))


@query(
    "safety_clip",
    f"""WITH {TOK} SELECT doc_id, len(p) > 100 AS clipped, CAST(CASE WHEN len(p) > 100 THEN 0 ELSE 2 END AS INTEGER) AS n_ids, sha256(array_to_string(p[1:100], '')) AS text_sha256 FROM tok""",
)
def safety_clip(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", tokens.pieces(F.col("text")).alias("p"))
    text, clipped, ids = selection.safely_clipped(F.col("p"), F.array(F.lit("1::0"), F.lit("1::1")), F.lit(100))
    return rows.select("doc_id", clipped.alias("clipped"), F.size(ids).alias("n_ids"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


@query(
    "turn_token_spans",
    f"""WITH {TOK}, {FACTS}, c AS (
      SELECT doc_id, a, b, length(array_to_string(p[1:a], '')) AS cs, length(array_to_string(p[1:b], '')) AS ce, p FROM facts
    ), o AS (
      SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS s FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS piece FROM c)
    ) SELECT c.doc_id, CAST(max(i) FILTER (WHERE o.s <= cs) AS INTEGER) AS s, CAST(max(i) FILTER (WHERE o.s <= greatest(ce - 1, cs)) + 1 AS INTEGER) AS e FROM c JOIN o USING (doc_id) GROUP BY c.doc_id""",
)
def turn_token_spans(spark, sf_dir):
    """Character spans to token spans, the token with the last character included: planted passages come back whole."""
    rows = planted(documents(spark, sf_dir), keep=("p",))
    return rows.select("doc_id", selection.turn_span_of_pieces(F.col("p"), F.col("char_start"), F.col("char_end")).alias("x")).select("doc_id", "x.s", "x.e")


@query(
    "spans_of_ids",
    """WITH x AS (
      SELECT o_orderkey, unnest(list_filter([o_orderkey % 7, o_orderkey % 7 + 1, o_orderkey % 11], lambda n: n <> 5)) AS n FROM orders
    ), s AS (SELECT DISTINCT o_orderkey, n * 48 AS s, n * 48 + 64 AS e FROM x), m AS (
      SELECT *, CASE WHEN s <= max(e) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY o_orderkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_orderkey ORDER BY s) AS island FROM m), r AS (SELECT o_orderkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_orderkey, island)
    SELECT o.o_orderkey, CAST(count(r.s) AS INTEGER) AS n_spans, CAST(coalesce(sum(e - r.s), 0) AS INTEGER) AS n_tokens FROM orders o LEFT JOIN r USING (o_orderkey) GROUP BY o.o_orderkey""",
)
def spans_of_ids(spark, sf_dir):
    """Chunk ids by arithmetic; number five is written badly and skipped."""
    numbers = [F.col("o_orderkey") % 7, F.col("o_orderkey") % 7 + 1, F.col("o_orderkey") % 11]
    ids = F.array(*(F.concat(F.lit("a::b::"), F.when(n == 5, "five").otherwise(n.cast("string"))) for n in numbers), F.lit("no number"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", selection.spans_of_ids(ids, 64, 16).alias("m"))
    return rows.select("o_orderkey", F.size("m").alias("n_spans"), spans.length(F.col("m")).alias("n_tokens"))


@query(
    "cohort_filters",
    f"""WITH {TOK} SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN count(*) = (SELECT count(*) FROM documents WHERE lang = 'en' AND text <> '') ELSE count(*) = -1 END AS as_expected FROM tok WHERE len(p) >= 1 AND lang IN ('en', 'de') GROUP BY lang""",
)
def cohort_filters(spark, sf_dir):
    """Cohorts by language and least source length, and whether they have their expected sizes."""
    rows = documents(spark, sf_dir).where(F.col("lang").isin("en", "de")).where(tokens.count(F.col("text")) >= 1)
    whole = table(spark, sf_dir, "documents").where("lang = 'en' AND text <> ''").count()
    selection.require_count(rows.where("lang = 'en'"), whole)
    expected = F.when(F.col("lang") == "en", F.lit(whole)).otherwise(-1)
    return rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", (F.col("n") == expected).alias("as_expected"))


@query(
    "context_window_guard",
    "SELECT doc_id, strlen(text) + 1024 <= 4096 AS fits, (strlen(text) * 0.1::DOUBLE + 1024 * 0.4::DOUBLE) / 1e6 * 1.01::DOUBLE AS reserved FROM documents",
)
def context_window_guard(spark, sf_dir):
    """Whether a call fits the reader's window, and what it reserves; bytes stand in for native tokens, which they bound."""
    native = F.octet_length("text")
    return documents(spark, sf_dir).select("doc_id", selection.window_guard(native, F.lit(spend.OUTPUT_CAP), 4096).alias("fits"), spend.judge_reservation(F.col("text")).alias("reserved"))


LOG = """log AS (
  SELECT user_id * 100 + day(ts) AS key, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS seq, CASE WHEN user_id % 2 = 0 THEN 'reader' ELSE 'judge' END AS category,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN 'reserve' ELSE 'settle' END AS action, value AS amount FROM events
)"""


def spend_log(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").withColumn("key", F.col("user_id") * 100 + F.dayofmonth("ts"))
    action = F.when(F.col("event_type").isin("click", "view", "error"), "reserve").otherwise("settle")
    seq = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return rows.select("key", seq.alias("seq"), F.when(F.col("user_id") % 2 == 0, "reader").otherwise("judge").alias("category"), action.alias("action"), F.col("value").alias("amount"))


SPENT = LOG + """, firsts AS (
  SELECT key, min(seq) FILTER (WHERE action = 'reserve') AS first, count(*) FILTER (WHERE action = 'reserve') AS tries, max(seq) FILTER (WHERE action = 'settle') AS last FROM log GROUP BY key
), spent AS (
  SELECT f.key, r.category, r.amount AS reserved, CASE WHEN f.last > f.first THEN s.amount END AS cost, f.tries - 1 AS refused
  FROM firsts f JOIN log r ON r.key = f.key AND r.seq = f.first LEFT JOIN log s ON s.key = f.key AND s.seq = f.last
)"""


@query("spend_states", f"WITH {SPENT} SELECT key, category, reserved, cost, refused, CASE WHEN cost IS NULL THEN 'reserved' ELSE 'complete' END AS state, cost IS NULL AS blocked FROM spent")
def spend_states(spark, sf_dir):
    """What a log of reservations and settlements says of each key: once reserved, a key is refused until it is inspected."""
    return spend.states(spend_log(spark, sf_dir))


@query(
    "spend_ceilings",
    f"""WITH {SPENT}, t AS (SELECT key, category, reserved, sum(reserved) OVER (PARTITION BY category ORDER BY key) AS total FROM spent)
    SELECT category, count(*) FILTER (WHERE total <= 5000) AS granted, round(max(total) FILTER (WHERE total <= 5000), 4) AS spent FROM t GROUP BY category""",
)
def spend_ceilings(spark, sf_dir):
    asked = spend.states(spend_log(spark, sf_dir)).select("key", "category", F.col("key").alias("seq"), F.col("reserved").alias("amount"))
    ceilings = spark.createDataFrame([("reader", 5000.0), ("judge", 5000.0)], "category string, ceiling double")
    rows = spend.within_ceiling(asked, ceilings).join(asked.select("key", "amount"), "key")
    return rows.groupBy("category").agg(F.count_if("granted").alias("granted"), F.round(F.max(F.when(F.col("granted"), F.col("spent") + F.col("amount"))), 4).alias("spent"))


@query(
    "usage_costs",
    "SELECT o_orderpriority AS priority, round(sum((o_totalprice * 0.1::DOUBLE + o_custkey * 0.4::DOUBLE) / 1e6::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS cost FROM orders GROUP BY 1",
)
def usage_costs(spark, sf_dir):
    """What reader calls cost by their usage; batches cost half."""
    cost = costs.usage_cost(F.col("o_totalprice").cast("double"), F.col("o_custkey"), F.col("o_orderkey") % 2 == 0)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.sum(cost), 6).alias("cost"))


@query(
    "budget_labels",
    "SELECT o_orderkey, (['32000', 'inf', '500', 'None', 'FULL', '64000', 'x'])[1 + o_orderkey % 7] AS label, CAST(([32000, NULL, 500, NULL, NULL, 64000, NULL])[1 + o_orderkey % 7] AS INTEGER) AS budget, (['32K', 'inf', '500', 'inf', 'inf', '64K', 'inf'])[1 + o_orderkey % 7] AS shown FROM orders",
)
def budget_labels(spark, sf_dir):
    label = pick(("32000", "inf", "500", "None", "FULL", "64000", "x"), F.col("o_orderkey") % 7)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), costs.budget_from_label(label).alias("budget"))
    return rows.withColumn("shown", costs.budget_label(F.col("budget")))


#: An annotation is a document's planted passage; some name no reviewer, another source, another text, or are not reviewed.
ANNOTATED = TOK + ", " + FACTS + """, notes AS (
  SELECT doc_id, a, b, doc_id % 6 AS kind, array_to_string(p, '') AS context, length(array_to_string(p[1:a], '')) AS cs, length(array_to_string(p[1:b], '')) AS ce, gold FROM facts
), stored AS (
  SELECT *, CASE kind WHEN 1 THEN 'draft' ELSE 'reviewed' END AS review, CASE WHEN kind <> 2 THEN 'someone' END AS reviewer, CASE kind WHEN 3 THEN reverse(sha256(context)) ELSE sha256(context) END AS source_sha256,
         CASE kind WHEN 5 THEN NULL WHEN 4 THEN upper(gold) ELSE gold END AS quoted FROM notes
), judged AS (
  SELECT *, CASE WHEN review <> 'reviewed' THEN 'not_reviewed' WHEN coalesce(reviewer, '') = '' THEN 'no_reviewer' WHEN source_sha256 <> sha256(context) THEN 'source_changed'
                 WHEN coalesce(quoted, '') = '' THEN 'no_support' WHEN substr(context, cs + 1, ce - cs) <> quoted THEN 'span_mismatch' ELSE 'ok' END AS status FROM stored
)"""


def annotations(spark, sf_dir):
    """``doc_id, status, reviewer, source_sha256, context, char_start, char_end, quoted, token_start, token_end, lang, p``"""
    from tidewater.operators.evidence import planted

    rows = planted(documents(spark, sf_dir), keep=("p",)).withColumn("context", tokens.decode(F.col("p")))
    kind = F.pmod("doc_id", F.lit(6))
    digest = F.sha2(F.col("context").cast("binary"), 256)
    return rows.select(
        "*",
        F.when(kind == 1, "draft").otherwise("reviewed").alias("review"),
        F.when(kind != 2, "someone").alias("reviewer"),
        F.when(kind == 3, F.reverse(digest)).otherwise(digest).alias("source_sha256"),
        F.when(kind == 5, F.lit(None)).when(kind == 4, F.upper("gold")).otherwise(F.col("gold")).alias("quoted"),
    )


@query("annotation_integrity", f"WITH {ANNOTATED} SELECT doc_id, status FROM judged")
def annotation_integrity(spark, sf_dir):
    from tidewater.operators.evidence import annotation_status

    return annotations(spark, sf_dir).select("doc_id", annotation_status().alias("status"))


@query(
    "reviewed_recall",
    f"""WITH {ANNOTATED} SELECT status = 'ok' AS reviewed, count(*) AS n, round(avg(CASE WHEN status <> 'ok' THEN NULL WHEN a >= 0 AND b <= 128 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM judged GROUP BY 1""",
)
def reviewed_recall(spark, sf_dir):
    """Recall of the first 128 tokens over annotations that hold; the others are counted and not scored."""
    from tidewater.operators.evidence import annotation_status

    ok = annotation_status() == "ok"
    rows = annotations(spark, sf_dir).select(ok.alias("reviewed"), spans.covers(F.array(F.struct(F.lit(0).alias("s"), F.lit(128).alias("e"))), F.col("token_start"), F.col("token_end")).alias("hit"))
    return rows.groupBy("reviewed").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("reviewed"), F.col("hit").cast("double"))), 6).alias("recall"))


@query(
    "controls_as_evidence",
    f"""WITH {TOK}, {FACTS}, kept AS (
      SELECT doc_id, control, range(CASE control WHEN 'full_context' THEN len(p) ELSE 0 END) AS tokens, range(a, b) AS gold FROM facts, (VALUES ('full_context'), ('empty_context')) c(control)
    ) SELECT doc_id, control, list_has_all(tokens, gold) AS hit FROM kept""",
)
def controls_as_evidence(spark, sf_dir):
    """Controls are scored like selections: the whole text is one span, the empty one has none."""
    facts = planted(documents(spark, sf_dir), keep=("p",))
    whole = facts.select("doc_id", F.lit("full_context").alias("control"), F.lit(0).alias("s"), F.size("p").alias("e"))
    empty = facts.select("doc_id", F.lit("empty_context").alias("control"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    return span_hits(whole.unionByName(empty), facts.drop("p"), ["doc_id"]).select("doc_id", "control", "hit")


SIDES = """sides AS (
  SELECT user_id * 100 + day(ts) AS example_id, user_id % 41 AS cluster, event_type AS method, avg(value) AS v FROM events GROUP BY ALL
), l AS (SELECT example_id, cluster, CASE WHEN example_id % 13 <> 0 THEN v END AS value, example_id % 17 <> 0 AS evaluable FROM sides WHERE method = 'click'
), r AS (SELECT example_id, cluster, CASE WHEN example_id % 11 <> 0 THEN v END AS value, example_id % 19 <> 0 AS evaluable FROM sides WHERE method = 'view'
), pairs AS (SELECT l.cluster, coalesce(l.value, 0) - coalesce(r.value, 0) AS d, l.value IS NOT NULL AND r.value IS NOT NULL AS whole FROM l JOIN r USING (example_id) WHERE l.evaluable AND r.evaluable
), clusters AS (SELECT cluster, sum(d) AS s, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM pairs GROUP BY cluster
), draws AS (SELECT t.r, sum(c.s) / sum(c.n) AS x FROM clusters p, range(200) t(r) JOIN clusters c ON c.i = ((t.r * 7919 + p.i * 104729 + 12345) * 1103515245::BIGINT) % 2147483648 % p.k GROUP BY t.r)"""


@query(
    "paired_interval",
    f"""WITH {SIDES} SELECT round((SELECT sum(s) / sum(n) FROM clusters), 6) AS estimate, (SELECT count(*) FROM clusters) AS n_clusters, (SELECT round(quantile_cont(x, 0.025), 6) FROM draws) AS lo, (SELECT round(quantile_cont(x, 0.975), 6) FROM draws) AS hi,
      (SELECT count(*) FROM pairs) AS n_paired, (SELECT count(*) FROM pairs WHERE whole) AS n_complete_pairs, (SELECT count(*) FROM l ANTI JOIN r USING (example_id)) AS n_unpaired_left,
      (SELECT count(*) FROM r ANTI JOIN l USING (example_id)) AS n_unpaired_right, (SELECT count(*) FROM l JOIN r USING (example_id) WHERE NOT (l.evaluable AND r.evaluable)) AS n_missing_annotations""",
)
def paired_interval(spark, sf_dir):
    """Two methods on the same examples: failures are 0, clusters are drawn as pairs, unpaired examples are counted."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("example_id"), (F.col("user_id") % 41).alias("cluster"), "event_type").agg(F.avg("value").alias("v"))
    side = lambda kind, fails, blind: rows.where(F.col("event_type") == kind).select("example_id", "cluster", F.when(F.col("example_id") % fails != 0, F.col("v")).alias("value"), (F.col("example_id") % blind != 0).alias("evaluable"))
    return S.paired_interval(side("click", 13, 17), side("view", 11, 19))


@query(
    "price_file_costs",
    """WITH p(model, i, o, thr, il, ol) AS (VALUES ('gemini-3.1-pro-preview', 2.0, 12.0, 200000, 4.0, 18.0), ('gemini-3-flash-preview', 0.5, 3.0, NULL, NULL, NULL), ('gemini-3.5-flash-lite', 0.3, 2.5, NULL, NULL, NULL), ('gpt-4o-mini', 0.15, 0.6, NULL, NULL, NULL)), c AS (
      SELECT o_orderkey, (['gemini-3.1-pro-preview', 'gemini-3-flash-preview', 'gemini-3.5-flash-lite', 'gpt-4o-mini'])[1 + o_orderkey % 4] AS model, CAST(floor(o_totalprice) AS BIGINT) AS n, o_custkey AS m, o_orderkey % 100 AS t FROM orders
    ) SELECT o_orderkey, model, round((n * CASE WHEN coalesce(n > thr, false) THEN il ELSE i END + (m + t) * CASE WHEN coalesce(n > thr, false) THEN ol ELSE o END)::DOUBLE / 1e6, 8) AS cost FROM c JOIN p USING (model)""",
)
def price_file_costs(spark, sf_dir):
    """Calls by the rows of a versioned price file; a model that it lacks would raise."""
    prices, _ = costs.read_prices(PRICE_FILE)
    model = pick(("gemini-3.1-pro-preview", "gemini-3-flash-preview", "gemini-3.5-flash-lite", "gpt-4o-mini"), F.col("o_orderkey") % 4)
    calls = table(spark, sf_dir, "orders").select("o_orderkey", model.alias("model"), F.floor("o_totalprice").alias("input_tokens"), F.col("o_custkey").alias("output_tokens"), (F.col("o_orderkey") % 100).alias("thought_tokens"))
    return costs.api_cost(calls, costs.model_prices(spark, prices), strict=True).select("o_orderkey", "model", "cost")


@query(
    "rerank_yes_no",
    """WITH pairs AS (
      SELECT q.vec_id AS probe_id, c.vec_id, c.embedding[1] AS yes, c.embedding[2] AS no,
             round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda x: x[1] * x[2])), 5) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), dense AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id) AS rank FROM pairs
    ), second AS (SELECT *, round(1 / (1 + exp(no::DOUBLE - yes::DOUBLE)), 6) AS p_yes FROM dense WHERE rank <= greatest(10, CAST(ceil(512 / 64.0) AS INTEGER) + 8)
    ), r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY p_yes DESC, rank) AS second_rank FROM second)
    SELECT probe_id, vec_id, p_yes, second_rank FROM r WHERE second_rank * 65 - 1 <= 512""",
)
def rerank_yes_no(spark, sf_dir):
    """As many candidates as a budget of 512 could need and eight more, rescored by yes against no, stable, packed by chunks of 64."""
    from tidewater.operators.ranking import candidates_needed, rerank, yes_share

    vectors = table(spark, sf_dir, "embeddings")
    probes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    top = dense_topk(probes, vectors.select("vec_id", "embedding"), candidates_needed(10, 512, 64))
    logits = vectors.select("vec_id", F.col("embedding")[0].cast("double").alias("yes"), F.col("embedding")[1].cast("double").alias("no"))
    rows = rerank(top.join(logits, "vec_id"), yes_share(F.col("yes"), F.col("no")))
    fits = F.col("second_rank") * 65 - 1 <= 512  # a separator after the first
    return rows.where(fits).select("probe_id", "vec_id", F.col("second_score").alias("p_yes"), F.col("second_rank").cast("long").alias("second_rank"))


@query(
    "dense_chunks_pack",
    """WITH pairs AS (
      SELECT q.vec_id AS probe_id, c.vec_id, 20 + c.vec_id % 60 AS n, round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda x: x[1] * x[2])), 5) AS score
      FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id AND q.label = c.label WHERE q.vec_id % 50 = 0
    ), dense AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id) AS rank FROM pairs
    ), used AS (SELECT *, sum(n + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY probe_id ORDER BY rank) AS used FROM dense)
    SELECT probe_id, count(*) AS kept, CAST(max(used) AS BIGINT) AS tokens FROM used WHERE used <= 256 GROUP BY probe_id""",
)
def dense_chunks_pack(spark, sf_dir):
    """Chunks of the probe's own context (its label) by dot product, packed under a budget of 256."""
    from tidewater.operators.ranking import dot

    vectors = table(spark, sf_dir, "embeddings")
    probes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"), "label")
    rows = vectors.join(probes, "label").where("vec_id <> probe_id").select("probe_id", "vec_id", F.round(dot(F.col("probe"), F.col("embedding")), 5).alias("score"))
    rows = ranked(rows, "probe_id", "score", "vec_id").withColumns({"token_start": F.lit(0), "token_end": (20 + F.col("vec_id") % 60).cast("int")})
    packed = pack_concat(rows, [256], "probe_id")
    return packed.groupBy("probe_id").agg(F.count("*").alias("kept"), F.max("used").cast("long").alias("tokens"))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("byte_bpe_pack")
def byte_bpe_pack(spark, sf_dir):
    """Packing under 128 tokens of a byte-level BPE. SQL has no such tokenizer; tests hold it against a loop over the library."""
    items = table(spark, sf_dir, "benchmark")
    docs = documents(spark, sf_dir).select("doc_id", "text", F.pmod("doc_id", F.lit(items.count())).alias("item_id"))
    rows = docs.join(items.select("item_id", F.col("text").alias("query")), "item_id")
    return byte_tokens.pack_by_tokens(rows, ranks_path(), 128).select("doc_id", "n_chunks", "kept_chunks", "selected_tokens", F.size("spans").alias("n_spans"), F.sha2(F.col("filtered_text").cast("binary"), 256).alias("text_sha256"))


@query("byte_bpe_clip")
def byte_bpe_clip(spark, sf_dir):
    """Texts cut to 100 tokens of a byte-level BPE, and how many they have then."""
    text = byte_tokens.clip(ranks_path(), 100)(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", text.alias("t"))
    return rows.select("doc_id", byte_tokens.count(ranks_path())(F.col("t")).alias("n_tokens"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
