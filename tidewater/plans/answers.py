"""Queries over answers: value, name and label matches, scorers, judgments, digests. Golds and answers are made from orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators.spend import judge_reservation
from tidewater.plans.context import documents
from tidewater.plans.registry import query, table


NUMBER, MARKS = X.NUMBER, r"[(),$% \t\n\r]"


def scale_sql(text: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({text}), '(^|[^a-z0-9_]){word}s?($|[^a-z0-9_])') THEN {factor}" for word, factor in X.SCALES.items())
    return f"(CASE {cases} ELSE 1 END)"


def cents_sql(token: str) -> str:
    """A number's magnitude in hundredths, which are exact."""
    return rf"CAST(round(CAST(regexp_extract(regexp_replace({token}, '{MARKS}', '', 'g'), '[0-9]+(?:\.[0-9]+)?') AS DOUBLE) * 100) AS HUGEINT)"


#: The SQL side reads numbers as the rule says: as they stand, times the unit in the 20 characters after, times the text's unit.
VALUES = f"""found AS (
  SELECT *, regexp_extract_all(answer, '{NUMBER}') AS found, string_split_regex(answer, '{NUMBER}') AS between FROM texts
), follow AS (
  SELECT *, list_transform(range(len(found)), lambda k: left(array_to_string(list_transform(range(k, len(found)), lambda j: coalesce(between[j + 2], '') || coalesce(found[j + 2], '')), ''), 20)) AS rest FROM found
), vals AS (
  SELECT *, list_sort(list_distinct(flatten(list_transform(range(len(found)), lambda k: [{cents_sql('found[k + 1]')}, {cents_sql('found[k + 1]')} * {scale_sql('rest[k + 1]')}, {cents_sql('found[k + 1]')} * {scale_sql('answer')}])))) AS vals FROM follow
)"""

AMOUNTS = """texts AS (
  SELECT o_orderkey, CASE kind WHEN 4 THEN g || ' in thousands' WHEN 6 THEN CAST(v // 1000 AS VARCHAR) || ' thousand' WHEN 7 THEN '(' || g || '.50)' ELSE '$' || g END AS gold,
         CASE kind WHEN 0 THEN 'The total is $' || g || ' in all.' WHEN 1 THEN 'A loss of (' || v || ')' WHEN 2 THEN '-' || v || '.0 reported' WHEN 3 THEN 'about ' || (v + 1) WHEN 4 THEN v || '000 dollars' WHEN 5 THEN 'no figure given'
           WHEN 6 THEN 'some 12% of it, ' || (v // 1000 * 1000) || ', in 3 parts' WHEN 7 THEN 'from 7 to ' || v || '.5 or ' || c || ' millions' ELSE '1 million, not ' || c || ' thousand; ' || o_orderkey || ' in all' END AS answer
  FROM (SELECT o_orderkey, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS v, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS g, o_orderkey % 9 AS kind FROM orders)
)"""


def amounts(spark, sf_dir):
    """``o_orderkey, gold, answer``: amounts in many guises, near misses among them."""
    v, kind, c = F.floor("o_totalprice"), F.col("o_orderkey") % 9, F.col("o_custkey").cast("string")
    text, grouped, thousands = v.cast("string"), F.format_number(v, 0), F.floor(v / 1000)
    say = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    gold = F.when(kind == 4, say(grouped, " in thousands")).when(kind == 6, say(thousands.cast("string"), " thousand")).when(kind == 7, say("(", grouped, ".50)")).otherwise(say("$", grouped))
    answer = (
        F.when(kind == 0, say("The total is $", grouped, " in all."))
        .when(kind == 1, say("A loss of (", text, ")"))
        .when(kind == 2, say("-", text, ".0 reported"))
        .when(kind == 3, say("about ", (v + 1).cast("string")))
        .when(kind == 4, say(text, "000 dollars"))
        .when(kind == 5, F.lit("no figure given"))
        .when(kind == 6, say("some 12% of it, ", (thousands * 1000).cast("string"), ", in 3 parts"))
        .when(kind == 7, say("from 7 to ", text, ".5 or ", c, " millions"))
        .otherwise(say("1 million, not ", c, " thousand; ", F.col("o_orderkey").cast("string"), " in all"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", gold.alias("gold"), answer.alias("answer"))


@query(
    "value_match_numeric",
    f"WITH {AMOUNTS}, {VALUES} SELECT o_orderkey, list_has_any(vals, [{cents_sql('gold')}, {cents_sql('gold')} * {scale_sql('gold')}]) AS matched FROM vals",
)
def value_match_numeric(spark, sf_dir):
    """Whether a magnitude of the gold value is exactly one that the answer can mean."""
    return amounts(spark, sf_dir).select("o_orderkey", X.value_match(F.col("gold"), F.col("answer")).alias("matched"))


@query("number_values", f"WITH {AMOUNTS}, {VALUES} SELECT o_orderkey, array_to_string(vals, ' ') AS cents FROM vals")
def number_values(spark, sf_dir):
    """Magnitudes that an answer can mean, in hundredths."""
    cents = F.array_sort(F.array_distinct(F.transform(X.number_values(F.col("answer")), lambda v: (v * 100).cast("long"))))
    return amounts(spark, sf_dir).select("o_orderkey", F.array_join(cents.cast("array<string>"), " ").alias("cents"))


@query(
    "value_match_entity",
    """WITH x AS (
      SELECT p_partkey, p_name || ' Corp.' AS gold, CASE p_partkey % 3 WHEN 0 THEN 'it was someone else' ELSE 'It was (' || upper(p_name) || '), Inc.' END AS answer FROM part
    ), w AS (
      SELECT p_partkey, list_filter(string_split_regex(regexp_replace(lower(gold), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '' AND NOT list_contains(['inc','co','corp','corporation','ltd','llc','plc','the','group','holdings','company','incorporated','and','of'], x)) AS g,
             string_split_regex(regexp_replace(lower(answer), '[^a-z0-9 ]', ' ', 'g'), ' +') AS said FROM x
    ) SELECT p_partkey, len(g) > 0 AND len(list_filter(g, lambda x: NOT list_contains(said, x))) = 0 AS matched FROM w""",
)
def value_match_entity(spark, sf_dir):
    name = F.col("p_name")
    answer = F.when(F.col("p_partkey") % 3 == 0, F.lit("it was someone else")).otherwise(F.concat(F.lit("It was ("), F.upper(name), F.lit("), Inc.")))
    return table(spark, sf_dir, "part").select("p_partkey", X.name_match(F.concat(name, F.lit(" Corp.")), answer).alias("matched"))


LABELS = ("kitchen", "garden", "office", "bedroom")


@query(
    "label_compare",
    f"""WITH x AS (
      SELECT o_orderkey, {list(LABELS)}[1 + o_orderkey % 4] AS gold, {list(LABELS)}[1 + o_custkey % 4] AS said, {list(LABELS)}[1 + (o_orderkey + 1) % 4] AS asked, o_custkey % 5 AS kind FROM orders
    ), y AS (
      SELECT *, CASE kind WHEN 0 THEN 'In the ' || upper(said) || '. Not the garden, not the office' WHEN 1 THEN 'the ' || said || ' or the ' || gold WHEN 2 THEN 'nowhere' WHEN 3 THEN said || '<example>the ' || gold ELSE 'Surely the ' || gold END AS output,
             'Where was it before the ' || asked || '?' AS question FROM x
    ), z AS (
      SELECT *, lower(split_part(split_part(split_part(lower(output), '.', 1), '<context>', 1), '<example>', 1)) AS first FROM y
    ), n AS (SELECT *, list_filter({list(LABELS)}, lambda l: contains(first, l) AND NOT contains(lower(question), l)) AS named FROM z)
    SELECT o_orderkey, len(named) = 1 AND list_contains(named, gold) AS correct FROM n""",
)
def label_compare(spark, sf_dir):
    """Whether the gold label is the only one that the answer's first sentence names beyond those of the question."""
    labels = F.array(*map(F.lit, LABELS))
    at = lambda k: F.get(labels, k.cast("int"))
    key, kind, said = F.col("o_orderkey"), F.col("o_custkey") % 5, at(F.col("o_custkey") % 4)
    gold = at(key % 4)
    output = (
        F.when(kind == 0, F.concat(F.lit("In the "), F.upper(said), F.lit(". Not the garden, not the office")))
        .when(kind == 1, F.concat(F.lit("the "), said, F.lit(" or the "), gold))
        .when(kind == 2, F.lit("nowhere"))
        .when(kind == 3, F.concat(said, F.lit("<example>the "), gold))
        .otherwise(F.concat(F.lit("Surely the "), gold))
    )
    question = F.concat(F.lit("Where was it before the "), at((key + 1) % 4), F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.only_label(gold, output, question, labels).alias("correct"))


@query(
    "contains_scorers",
    """WITH x AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN 'first' || chr(10) || p_brand ELSE 'the ' || p_brand || ' one' END AS said FROM part)
    SELECT p_partkey, trim(said) = p_brand AS em, contains(trim(said), p_brand) AS contains_, string_split(trim(said), chr(10))[-1] = p_brand AS lastline_em,
           contains(string_split(trim(said), chr(10))[-1], p_brand) AS lastline_contains, contains(lower(said), lower(p_brand)) AS folded FROM x""",
)
def contains_scorers(spark, sf_dir):
    brand, kind = F.col("p_brand"), F.col("p_partkey") % 4
    said = F.when(kind == 0, brand).when(kind == 1, F.lower(brand)).when(kind == 2, F.concat(F.lit("first\n"), brand)).otherwise(F.concat(F.lit("the "), brand, F.lit(" one")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.scored_by("em", said, brand).alias("em"), X.scored_by("contains", said, brand).alias("contains_"), X.scored_by("lastline_em", said, brand).alias("lastline_em"),
        X.scored_by("lastline_contains", said, brand).alias("lastline_contains"), F.contains(F.lower(said), F.lower(brand)).alias("folded"),
    )


@query(
    "whole_word_match",
    r"""WITH x AS (
      SELECT p_partkey, 'Name' || p_size AS word, CASE p_partkey % 5 WHEN 0 THEN 'It is ' || upper('Name' || p_partkey % 50) || '.' WHEN 1 THEN 'It is Name' || p_size || 'son.' WHEN 2 THEN 'name_name' || p_size WHEN 3 THEN p_name || ', name' || p_size || ', ' || p_type ELSE p_name END AS said FROM part
    ) SELECT p_partkey, regexp_matches(lower(said), '(^|[^a-z0-9_])' || lower(word) || '($|[^a-z0-9_])') AS hit FROM x""",
)
def whole_word_match(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    word = F.concat(F.lit("Name"), size)
    said = (
        F.when(kind == 0, F.concat(F.lit("It is "), F.upper(F.concat(F.lit("Name"), (F.col("p_partkey") % 50).cast("string"))), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("It is Name"), size, F.lit("son.")))
        .when(kind == 2, F.concat(F.lit("name_name"), size))
        .when(kind == 3, F.concat("p_name", F.lit(", name"), size, F.lit(", "), "p_type"))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", X.whole_word(said, word).alias("hit"))


@query(
    "bracket_score",
    r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Rating: [[' || p_size || ']] of [9]' WHEN 1 THEN 'so [' || p_size || ']' WHEN 2 THEN 'none' ELSE '[[x]] then [' || p_size || ']' END AS t FROM part), y AS (
      SELECT p_partkey, CAST(coalesce(nullif(regexp_extract(t, '\[\[([0-9]+)\]\]', 1), ''), nullif(regexp_extract(t, '\[([0-9]+)\]', 1), '')) AS INTEGER) AS score FROM x)
    SELECT p_partkey, score, score NOT BETWEEN 1 AND 40 AS out_of_range FROM y""",
)
def bracket_score(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    t = F.when(kind == 0, F.concat(F.lit("Rating: [["), size, F.lit("]] of [9]"))).when(kind == 1, F.concat(F.lit("so ["), size, F.lit("]"))).when(kind == 2, F.lit("none")).otherwise(F.concat(F.lit("[[x]] then ["), size, F.lit("]")))
    return table(spark, sf_dir, "part").select("p_partkey", X.bracket_score(t).alias("score")).withColumn("out_of_range", ~F.col("score").between(1, 40))


SAID = ("yes", " YES. ", "No!", "yes, because", "", "no", "\n Yes!\t", "not yes", "NO.", "nope")


@query(
    "yesno_judgment",
    rf"""WITH x AS (SELECT o_orderkey, lower(trim(regexp_replace([{', '.join("'" + s + "'" for s in SAID)}][1 + o_orderkey % {len(SAID)}], '[ \t\n\r\f\v]+', ' ', 'g'))) AS said FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_matches(said, '^yes[.!]?$') THEN true WHEN regexp_matches(said, '^no[.!]?$') THEN false END AS correct FROM x""",
)
def yesno_judgment(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("o_orderkey") % len(SAID)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.yes_no(said).alias("correct"))


@query("reader_failures", """WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' ELSE 'text' END AS output, CASE event_id % 5 WHEN 0 THEN 'SAFETY' WHEN 1 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish FROM events)
    SELECT finish, CASE WHEN output = '' OR finish NOT IN ('STOP', 'MAX_TOKENS') THEN 'reader_failure' ELSE 'scored' END AS metric, count(*) AS n FROM x GROUP BY ALL""")
def reader_failures(spark, sf_dir):
    output = F.when(F.col("event_id") % 3 == 0, "").otherwise("text")
    finish = F.when(F.col("event_id") % 5 == 0, "SAFETY").when(F.col("event_id") % 5 == 1, "MAX_TOKENS").otherwise("STOP")
    metric = F.when((output == "") | ~finish.isin("STOP", "MAX_TOKENS"), "reader_failure").otherwise("scored")
    return table(spark, sf_dir, "events").groupBy(finish.alias("finish"), metric.alias("metric")).agg(F.count("*").alias("n"))


@query("text_digests", """SELECT doc_id, sha256(to_json(text)) AS canonical, sha256(text) AS plain, sha1(text) AS short FROM documents""")
def text_digests(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.text_digest(F.col("text")).alias("canonical"), F.sha2(F.col("text").cast("binary"), 256).alias("plain"), F.sha1("text").alias("short"))


@query(
    "whitespace_fold",
    r"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))) AS folded FROM documents""",
)
def whitespace_fold(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(X.fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query("sentence_split", r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1))) AS n, string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1))[1] AS first FROM documents""")
def sentence_split(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("first"))


@query(
    "prompt_projection",
    """SELECT c.conv_id, c.turn, replace(replace('Context: {context} Question: {question}', '{context}', coalesce(p.text, '')), '{question}', c.text) AS prompt
    FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.role = 'user'""",
)
def prompt_projection(spark, sf_dir):
    """A prompt holds context and question, never gold or method."""
    rows = table(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    rows = rows.where("role = 'user'").join(before, ["conv_id", "turn"], "left")
    filled = F.replace(F.replace(F.lit("Context: {context} Question: {question}"), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("text"))
    return rows.select("conv_id", "turn", filled.alias("prompt"))


@query(
    "judge_prompts",
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Does the answer decline? ' WHEN lang = 'en' THEN 'Same meaning? ' ELSE 'Same facts? ' END || coalesce(text, '') AS prompt FROM documents)
    SELECT doc_id, sha256(prompt) AS prompt_sha256, (strlen(prompt) * 0.1::DOUBLE + 1024 * 0.4::DOUBLE) / 1e6::DOUBLE * 1.01::DOUBLE AS reserved FROM x""",
)
def judge_prompts(spark, sf_dir):
    """Judge prompts by question type, and the conservative reservation for the whole of each."""
    lead = F.when(F.col("doc_id") % 7 == 0, "Does the answer decline? ").when(F.col("lang") == "en", "Same meaning? ").otherwise("Same facts? ")
    rows = documents(spark, sf_dir).select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("prompt"))
    return rows.select("doc_id", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"), judge_reservation(F.col("prompt")).alias("reserved"))
