"""Queries over evidence: what selections keep of a planted passage, of annotated turns and of candidate lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import spans
from tidewater.functions.text import fold, value_match
from tidewater.operators.evidence import planted, recall, route, session_recall, set_metrics, verbatim_hits
from tidewater.operators.packing import pack_concat
from tidewater.operators.ranking import bm25_texts
from tidewater.operators.selectors import select_all
from tidewater.plans.context import documents
from tidewater.plans.registry import BM25, BUDGET_ROWS, BUDGETS, TOK, query, table

FACTS = """facts AS (
  SELECT doc_id, lang, p, a, b, array_to_string(p[a + 1:b], '') AS gold FROM (
    SELECT doc_id, lang, p, CAST(floor(len(p) * (1.0::DOUBLE / 3)) AS INTEGER) AS a, CAST(least(CAST(floor(len(p) * (1.0::DOUBLE / 3)) AS INTEGER) + 12, len(p)) AS INTEGER) AS b FROM tok
  ) WHERE b > a
)"""


def norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(
    "char_to_token_span",
    f"""WITH {TOK}, {FACTS} SELECT doc_id, a AS s, b AS e, CAST(length(array_to_string(p[1:a], '')) AS INTEGER) AS char_start FROM facts""",
)
def char_to_token_span(spark, sf_dir):
    """Characters of planted passages back to tokens, by the offsets of the text's pieces."""
    from tidewater.functions.tokens import piece_offsets

    docs = documents(spark, sf_dir)
    offsets = piece_offsets(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list("char_start")).alias("offsets"))
    rows = planted(docs).join(offsets, "doc_id")
    return rows.select("doc_id", spans.char_to_token(F.col("offsets"), F.col("char_start"), F.col("char_end")).alias("x"), "char_start").select("doc_id", "x.s", "x.e", "char_start")


METHODS = f"""selections AS (
  SELECT doc_id, 'head' AS method, budget, 0 AS s, budget AS e, array_to_string(p[1:budget], '') AS t FROM tok, {BUDGET_ROWS} WHERE len(p) > budget
  UNION ALL SELECT doc_id, 'tail', budget, len(p) - budget, len(p), array_to_string(p[len(p) - budget + 1:], '') FROM tok, {BUDGET_ROWS} WHERE len(p) > budget
)"""


@query(
    "evidence_verbatim",
    f"""WITH {TOK}, {FACTS}, {METHODS} SELECT doc_id, method, CAST(budget AS INTEGER) AS budget, contains({norm('t')}, {norm('gold')}) AS hit FROM selections JOIN facts USING (doc_id)""",
)
def evidence_verbatim(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = verbatim_hits(select_all(docs, ["head", "tail"], BUDGETS), planted(docs).select("doc_id", "gold"), ["doc_id"])
    return hits.select("doc_id", "method", "budget", "hit")


PACKED_FACTS = BM25.replace("questions AS (\n  SELECT d.doc_id, b.text AS query FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)\n)", FACTS + ", questions AS (SELECT doc_id, gold AS query FROM facts)") + f""", costs AS (
  SELECT *, sum(token_end - token_start + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rank) AS used FROM ranked
), packed AS (
  SELECT doc_id, b.budget, token_start AS s, token_end AS e FROM costs, {BUDGET_ROWS} WHERE used <= b.budget
), marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id, budget ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM packed
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, budget ORDER BY s, e) AS island FROM marked
), merged AS (SELECT doc_id, budget, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, budget, island
), found AS (
  SELECT m.doc_id, m.budget, f.lang, bool_or(m.s <= f.a AND m.e >= f.b) AS hit FROM merged m JOIN facts f USING (doc_id) GROUP BY ALL
)"""


def packed_facts(spark, sf_dir):
    """What BM25 packs of each text with its planted passage as question. The passage's place is carried along, so no text is read twice."""
    facts = planted(documents(spark, sf_dir), keep=("p",)).select("doc_id", F.struct("lang", "token_start", "token_end").alias("fact"), "gold", "p")
    return pack_concat(bm25_texts(facts, F.col("gold"), ["doc_id", "fact"]), BUDGETS)


def packed_hits(spark, sf_dir):
    """The planted passage as question: is it in what BM25 packs?"""
    packed = packed_facts(spark, sf_dir)
    merged = spans.merge_rows(packed.select("doc_id", "fact", "budget", F.col("token_start").alias("s"), F.col("token_end").alias("e")), ["doc_id", "fact", "budget"])
    covered = (F.col("s") <= F.col("fact.token_start")) & (F.col("e") >= F.col("fact.token_end"))
    return merged.groupBy("doc_id", "fact", "budget").agg(F.bool_or(covered).alias("hit")).select("doc_id", "budget", "hit", "fact.lang")


@query("evidence_span_recall", f"WITH {PACKED_FACTS} SELECT doc_id, CAST(budget AS INTEGER) AS budget, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fraction_retained, hit AS all_retained, 1::BIGINT AS n_support FROM found")
def evidence_span_recall(spark, sf_dir):
    return recall(packed_hits(spark, sf_dir), ["doc_id", "budget"])


@query("evidence_by_method_budget", f"WITH {PACKED_FACTS} SELECT CAST(budget AS INTEGER) AS budget, lang, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall FROM found GROUP BY budget, lang")
def evidence_by_method_budget(spark, sf_dir):
    return packed_hits(spark, sf_dir).groupBy("budget", "lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall"))


@query(
    "span_covers",
    f"WITH {PACKED_FACTS} SELECT doc_id, CAST(budget AS INTEGER) AS budget, hit AS covered FROM found",
)
def span_covers(spark, sf_dir):
    lists = packed_facts(spark, sf_dir).groupBy("doc_id", "fact", "budget").agg(spans.merge_array(F.collect_list(F.struct(F.col("token_start").alias("s"), F.col("token_end").alias("e")))).alias("m"))
    return lists.select("doc_id", "budget", spans.covers(F.col("m"), F.col("fact.token_start"), F.col("fact.token_end")).alias("covered"))


#: A session is a pair of turns; the annotated turns are the user's longest in each session; a selection keeps the last turns.
TURNS = """turns AS (
  SELECT conv_id, turn, role, text, turn // 2 AS session, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY length(text) DESC, turn) AS r,
         sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
)"""


@query(
    "evidence_session_recall",
    f"""WITH {TURNS} SELECT conv_id, round(count(DISTINCT CASE WHEN back <= 2000 THEN session END)::DOUBLE / count(DISTINCT session), 6) AS session_recall,
      round(avg(CASE WHEN back <= 2000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS turn_recall, count(DISTINCT session) AS n_sessions FROM turns WHERE r = 1 GROUP BY conv_id""",
)
def evidence_session_recall(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("session", F.floor(F.col("turn") / 2))
    back = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("conv_id", "session").orderBy(F.desc(F.length("text")), "turn"))
    hits = rows.withColumn("hit", back <= 2000).withColumn("r", first).where("r = 1")
    return session_recall(hits, ["conv_id"])


@query(
    "evidence_set_metrics",
    """WITH x AS (
      SELECT o_custkey % 500 AS k, list(DISTINCT o_orderkey % 40) FILTER (WHERE o_orderstatus = 'O') AS chosen, list(DISTINCT o_orderkey % 40) FILTER (WHERE o_totalprice > 150000) AS gold FROM orders GROUP BY 1
    ), y AS (
      SELECT k, coalesce(len(list_intersect(gold, chosen)), 0)::DOUBLE AS b, coalesce(len(gold), 0) AS g, coalesce(len(chosen), 0) AS c FROM x
    ), z AS (SELECT k, b / nullif(g, 0) AS r, coalesce(b / nullif(c, 0), 0) AS p, b = g AS all_retained FROM y)
    SELECT k, round(r, 6) AS recall, round(p, 6) AS precision, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, all_retained FROM z""",
)
def evidence_set_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("k"))
    part = F.col("o_orderkey") % 40
    rows = rows.agg(F.collect_set(F.when(F.col("o_orderstatus") == "O", part)).alias("chosen"), F.collect_set(F.when(F.col("o_totalprice") > 150000, part)).alias("gold"))
    return rows.select("k", *(v.alias(k) if k == "all_retained" else F.round(v, 6).alias(k) for k, v in set_metrics(F.col("gold"), F.col("chosen")).items()))


@query(
    "evidence_router",
    """WITH m AS (SELECT doc_id, (['head', 'bm25', 'llmlingua2', 'provence', 'tail'])[1 + doc_id % 5] AS method, doc_id % 11 <> 0 AS complete, doc_id % 5 = 1 AS whole_chunks, doc_id % 3 = 0 AS redecodes FROM documents)
    SELECT method, CASE WHEN NOT complete THEN 'error' WHEN method IN ('llmlingua2', 'provence') THEN 'verbatim' WHEN whole_chunks OR redecodes THEN 'span' ELSE 'verbatim' END AS mode, count(*) AS n FROM m GROUP BY ALL""",
)
def evidence_router(spark, sf_dir):
    names = F.array(*map(F.lit, ("head", "bm25", "llmlingua2", "provence", "tail")))
    method = F.get(names, (F.col("doc_id") % 5).cast("int"))
    mode = route(method, F.col("doc_id") % 11 != 0, F.col("doc_id") % 5 == 1, F.col("doc_id") % 3 == 0)
    return documents(spark, sf_dir).groupBy(method.alias("method"), mode.alias("mode")).agg(F.count("*").alias("n"))


LINES = r"""lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), placed AS (
  SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(raw) - 1 AS off FROM lines
)"""


@query(
    "candidate_lines",
    rf"""WITH {LINES} SELECT doc_id, CAST(line_no + 1 AS INTEGER) AS line_number, CAST(off + length(raw) - length(ltrim(raw)) AS BIGINT) AS char_start, trim(raw) AS line
    FROM placed WHERE regexp_matches(raw, '[A-Za-z]{{3,}}') AND list_contains(string_split_regex(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g'), ' +'), 'license')""",
)
def candidate_lines(spark, sf_dir):
    """Lines that hold a gold answer (here a word), with their places in the text."""
    from pyspark.sql import Window

    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    so_far = F.sum(F.length("raw") + 1).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("off", so_far - F.length("raw") - 1).where(F.col("raw").rlike("[A-Za-z]{3,}") & value_match(F.lit("The License"), F.col("raw")))
    return rows.select("doc_id", (F.col("line_no") + 1).alias("line_number"), (F.col("off") + F.length("raw") - F.length(F.ltrim("raw"))).alias("char_start"), F.trim("raw").alias("line"))


@query(
    "candidate_line_survival",
    rf"""WITH {TOK}, {LINES}, c AS (
      SELECT doc_id, trim(raw) AS line FROM placed WHERE regexp_matches(raw, '[A-Za-z]{{3,}}') AND list_contains(string_split_regex(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g'), ' +'), 'license')
    ) SELECT doc_id, bool_or(contains({norm("lower(array_to_string(p[1:64], ''))")}, {norm('lower(line)')})) AS survived, count(*) AS n_candidates FROM c JOIN tok USING (doc_id) GROUP BY doc_id""",
)
def candidate_line_survival(spark, sf_dir):
    from tidewater.functions.tokens import decode, head, pieces

    docs = documents(spark, sf_dir).select("doc_id", decode(head(pieces(F.col("text")), F.lit(64))).alias("kept"))
    rows = candidate_lines(spark, sf_dir).join(docs, "doc_id").withColumn("hit", F.contains(fold(F.col("kept")), fold(F.col("line"))))
    return rows.groupBy("doc_id").agg(F.bool_or("hit").alias("survived"), F.count("*").alias("n_candidates"))
