"""Queries that generate datasets from documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import prepare as P
from tidewater.operators.evidence import planted
from tidewater.plans.context import digest, documents
from tidewater.plans.evidence import FACTS, LINES, candidate_lines
from tidewater.plans.registry import TOK, query, table

SENTENCES = r"""sents AS (SELECT doc_id, source, string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)"""
COUNT = r"len(regexp_extract_all({}, '[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$'))"


@query(
    "prep_needle_placement",
    f"""WITH {SENTENCES}, x AS (
      SELECT doc_id, s, (['Ana', 'Bo', 'Cy'])[1 + (doc_id + 1) % 3] || ' keeps the key.' AS needle, depth, CAST(greatest(1, CAST(floor(len(s) * depth::DOUBLE) AS INTEGER)) AS INTEGER) AS position FROM sents, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) d(depth)
    ), y AS (SELECT *, array_to_string(s[1:position], ' ') || ' ' AS b, array_to_string(s[position + 1:], ' ') AS a FROM x)
    SELECT doc_id, depth, position, sha256(b || needle || CASE WHEN a <> '' THEN ' ' || a ELSE '' END) AS context_sha256, CAST(length(b) AS INTEGER) AS char_start, CAST(length(b) + length(needle) AS INTEGER) AS char_end FROM y""",
)
def prep_needle_placement(spark, sf_dir):
    who = P.assigned(["Ana", "Bo", "Cy"], F.col("doc_id"), F.lit(1))
    needle = P.fill(F.lit("{CHAR} keeps the key."), {"CHAR": who})
    return P.place_needles(documents(spark, sf_dir), needle, [0.0, 0.5, 1.0]).select("doc_id", "depth", "position", digest("context").alias("context_sha256"), "char_start", "char_end")


@query(
    "prep_fact_injection",
    f"""WITH {SENTENCES}, r AS (
      SELECT doc_id, i - 1 AS position, 1 AS kind, 0 AS k, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sents)
      UNION ALL SELECT doc_id, (doc_id + k) % len(s), 0, k, 'Fact ' || k || ' holds.' FROM sents, range(3) t(k)
    ), n AS (SELECT *, {COUNT.format('text')} AS n FROM r), o AS (
      SELECT doc_id, kind, row_number() OVER w AS ord, n, sum(n) OVER w AS e FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY position, kind, k)
    ) SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(e - n AS BIGINT) AS token_start, CAST(e AS BIGINT) AS token_end FROM o WHERE kind = 0""",
)
def prep_fact_injection(spark, sf_dir):
    from tidewater.functions.text import sentences

    docs = documents(spark, sf_dir)
    facts = docs.select("doc_id", F.size(sentences(F.col("text"))).alias("n"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    facts = facts.select("doc_id", ((F.col("doc_id") + F.col("k")) % F.col("n")).cast("int").alias("position"), "k", F.concat(F.lit("Fact "), F.col("k").cast("string"), F.lit(" holds.")).alias("fact"))
    return P.inject_facts(docs, facts).where("kind = 0").select("doc_id", "ord", "token_start", "token_end")


@query(
    "prep_background",
    f"""WITH {SENTENCES}, r AS (SELECT source, doc_id, i, s[i] AS t FROM (SELECT source, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sents)), n AS (SELECT *, {COUNT.format('t')} AS n FROM r), k AS (
      SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id, i) AS used FROM n WHERE n >= 3) SELECT source, count(*) AS sentences, CAST(max(used) AS BIGINT) AS tokens FROM k WHERE used <= 1000 GROUP BY source""",
)
def prep_background(spark, sf_dir):
    return P.background(documents(spark, sf_dir), "source", 1000).groupBy("source").agg(F.count("*").alias("sentences"), F.max("used").alias("tokens"))


@query(
    "prep_conversation_history",
    """WITH l AS (
      SELECT *, CASE WHEN turn % 2 = 0 THEN 'Session ' || (turn // 2 + 1) || chr(10) ELSE '' END AS h FROM conversations
    ), m AS (SELECT *, h || role || ': ' || text || chr(10) AS line FROM l), n AS (
      SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn) - length(line) + length(h) + length(role) + 2 AS s FROM m
    ) SELECT conv_id, sha256(string_agg(line, '' ORDER BY turn)) AS history_sha256, count(*) AS turns, CAST(max(s) AS BIGINT) AS last_start, CAST(max(s + length(text)) AS BIGINT) AS last_end FROM n GROUP BY conv_id""",
)
def prep_conversation_history(spark, sf_dir):
    rows = P.render_history(table(spark, sf_dir, "conversations"))
    last = F.element_at("spans", -1)
    return rows.select("conv_id", digest("history").alias("history_sha256"), F.size("spans").cast("long").alias("turns"), last["s"].alias("last_start"), last["e"].alias("last_end"))


@query(
    "prep_doc_concat",
    """SELECT doc_id // 5 AS packet, CAST(count(*) AS INTEGER) AS n_docs, sha256(string_agg('## ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS context_sha256 FROM documents GROUP BY 1""",
)
def prep_doc_concat(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("packet", F.floor(F.col("doc_id") / 5))
    return P.join_documents(rows, "packet").select("packet", "n_docs", digest("context").alias("context_sha256"))


@query(
    "prep_question_samples",
    """WITH x AS (SELECT c_nationkey AS doc_id, c_custkey AS line_no, c_custkey % 9 + 1 AS number, c_custkey % 4 = 3 AS question FROM customer), y AS (
      SELECT *, sum(CASE WHEN number = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sample FROM x
    ), z AS (SELECT *, coalesce(sum(CASE WHEN question THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sample ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS facts FROM y)
    SELECT doc_id, CAST(sample AS BIGINT) AS sample, line_no, CAST(facts AS BIGINT) AS facts FROM z WHERE question""",
)
def prep_question_samples(spark, sf_dir):
    key = F.col("c_custkey")
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), key.alias("line_no"), (key % 9 + 1).alias("number"), (key % 4 == 3).alias("question"))
    return P.question_samples(lines)


@query(
    "prep_last_header",
    """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), m AS (
      SELECT *, CASE WHEN starts_with(line, 'The ') OR line_no = 0 THEN line_no END AS h FROM l
    ) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(max(h) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS header_line FROM m""",
)
def prep_last_header(spark, sf_dir):
    """The nearest header line at or before each line."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    head = F.when(F.startswith("line", F.lit("The ")) | (F.col("line_no") == 0), F.col("line_no"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("h", head).select("doc_id", "line_no", F.last("h", ignorenulls=True).over(order).alias("header_line"))


@query(
    "prep_seeded_candidates",
    """SELECT doc_id FROM documents WHERE n_chars > 1000 ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20""",
)
def prep_seeded_candidates(spark, sf_dir):
    """A seeded order of candidates, of which the first that pass are kept."""
    order = F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return documents(spark, sf_dir).where("n_chars > 1000").select("doc_id", order.alias("o")).orderBy("o", "doc_id").limit(20).select("doc_id")


TASK = """task AS (
  SELECT doc_id, 1 AS number, left(source, 3) || ' went there.' AS phrase, NULL AS answer, CAST([] AS INTEGER[]) AS support, 0 AS line_no FROM documents
  UNION ALL SELECT doc_id, 2, lang || ' stayed.', NULL, [], 1 FROM documents
  UNION ALL SELECT doc_id, 3, 'Where is ' || lang || '?', source, CASE WHEN doc_id % 2 = 0 THEN [1] ELSE [1, 2] END, 2 FROM documents
)"""


@query("prep_parse_facts", f"""WITH {TASK} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(number AS INTEGER) AS number, phrase, answer, array_to_string(support, ' ') AS support FROM task WHERE doc_id % 2 = 0 OR number < 4""")
def prep_parse_facts(spark, sf_dir):
    """Task files of numbered phrases, written from documents and parsed again."""
    support = F.when(F.col("doc_id") % 2 == 0, "1").otherwise("1 2")
    lines = [F.concat(F.lit("1 "), F.left("source", F.lit(3)), F.lit(" went there.")), F.concat(F.lit("2 "), "lang", F.lit(" stayed. ")), F.concat(F.lit("3 Where is "), "lang", F.lit("? \t"), "source", F.lit("\t"), support), F.lit("no number")]
    texts = documents(spark, sf_dir).select("doc_id", F.array_join(F.array(*lines), "\n").alias("text"))
    rows = P.parse_facts(texts)
    return rows.withColumn("support", F.array_join(F.col("support").cast("array<string>"), " "))


@query(
    "prep_cohort",
    f"""WITH {TOK}, {FACTS} SELECT doc_id, CAST(len(p) AS INTEGER) AS n_tokens FROM facts WHERE len(p) > 200 AND (doc_id % 3 <> 0 OR trim(gold) = trim(replace(gold, 'a', 'b')))""",
)
def prep_cohort(spark, sf_dir):
    """Contexts of over 200 tokens whose planted facts stand where they should; in a third of them the fact's text is altered."""
    rows = planted(documents(spark, sf_dir), keep=("p",))
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("gold", F.lit("a"), F.lit("b"))).otherwise(F.col("gold"))
    facts = F.array(F.struct(text.alias("text"), "token_start", "token_end"))
    return P.cohort(rows.select("doc_id", F.array_join("p", "").alias("context"), facts.alias("facts")), 200)


@query(
    "prep_review_packets",
    f"""WITH {LINES}, c AS (
      SELECT doc_id, line_no + 1 AS line_number, off + length(raw) - length(ltrim(raw)) AS s, trim(raw) AS line FROM placed
      WHERE regexp_matches(raw, '[A-Za-z]{{3,}}') AND list_contains(string_split_regex(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g'), ' +'), 'license')
    ) SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, sha256(substring(text, CAST(greatest(s - 80, 0) AS BIGINT) + 1, CAST(least(s + length(line) + 80, length(text)) - greatest(s - 80, 0) AS BIGINT))) AS shown_sha256 FROM c JOIN documents USING (doc_id)""",
)
def prep_review_packets(spark, sf_dir):
    """Candidate lines with 80 characters of text around them."""
    rows = P.review_packets(candidate_lines(spark, sf_dir), documents(spark, sf_dir), 80)
    return rows.select("doc_id", "line_number", digest("shown").alias("shown_sha256"))


@query(
    "prep_titled_documents",
    """SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN 'Report of ' || source || chr(10) WHEN 1 THEN '# ' || source || chr(10) || chr(10) ELSE 'Case ' || source || ':' || chr(10) END || text) AS text_sha256 FROM documents""",
)
def prep_titled_documents(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "financial").when(F.col("doc_id") % 3 == 1, "paper").otherwise("legal")
    return documents(spark, sf_dir).select("doc_id", F.sha2(P.by_type(kind, F.col("source"), F.col("text")).cast("binary"), 256).alias("text_sha256"))


@query(
    "prep_history_renderings",
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'), a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
    SELECT conv_id, 'user lines' AS form, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_sha256 FROM u WHERE r <= 2 GROUP BY conv_id
    UNION ALL SELECT conv_id, 'all json', sha256(string_agg(to_json({'role': role, 'content': text}), chr(10) ORDER BY turn)) FROM a WHERE r <= 4 GROUP BY conv_id""",
)
def prep_history_renderings(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    forms = {"user lines": P.render_turns(turns, True, False, 2), "all json": P.render_turns(turns, False, True, 4)}
    rows = [df.select("conv_id", F.lit(name).alias("form"), digest("history").alias("history_sha256")) for name, df in forms.items()]
    return rows[0].unionByName(rows[1])


@query(
    "prep_prompt_build",
    """SELECT doc_id, sha256('Read: ' || text || chr(10) || 'In ' || lang || ', about ' || source || '?') AS prompt_sha256 FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 5000""",
)
def prep_prompt_build(spark, sf_dir):
    """Prompts of chosen languages and lengths, by a template."""
    rows = documents(spark, sf_dir).where(F.col("lang").isin("en", "de") & F.col("n_chars").between(500, 5000))
    prompt = P.fill(F.lit("Read: {text}\nIn {lang}, about {source}?"), {"source": F.col("source"), "lang": F.col("lang"), "text": F.col("text")})
    return rows.select("doc_id", F.sha2(prompt.cast("binary"), 256).alias("prompt_sha256"))
