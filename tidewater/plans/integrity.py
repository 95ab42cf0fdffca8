"""Queries that audit stored results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import tokens
from tidewater.operators import integrity as I
from tidewater.operators.chunking import OVERLAP, SIZE, chunk_grid
from tidewater.operators.evidence import planted, verbatim_hits
from tidewater.operators.selectors import select_all
from tidewater.plans.context import documents
from tidewater.plans.evidence import FACTS
from tidewater.plans.registry import CHUNKS, TOK, query, table


@query("conflict_detect", """SELECT source, lang, count(DISTINCT md5(text)) AS digests FROM documents WHERE NOT coalesce(n_chars <> length(text), true) GROUP BY ALL HAVING count(DISTINCT md5(text)) > 1""")
def conflict_detect(spark, sf_dir):
    """Rows whose stated length is not their text's have failed, and can't be in conflict."""
    failed = F.coalesce(F.col("n_chars") != F.length("text"), F.lit(True))
    return I.conflicts(documents(spark, sf_dir).withColumn("digest", F.md5("text")), ["source", "lang"], "digest", failed)


@query(
    "repair_override",
    """WITH r AS (SELECT o_orderkey, o_orderkey % 4 = 0 AS failed, o_orderkey % 3 AS fingerprint, o_custkey AS value FROM orders), f AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey END AS repair_of, o_orderkey % 6 % 3 AS fingerprint, -o_custkey AS value FROM orders WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey, CASE WHEN ok THEN fv ELSE value END AS value, failed AND NOT ok AS failed, fv IS NOT NULL AND NOT ok AS refused FROM (
      SELECT r.*, f.value AS fv, coalesce(r.failed AND f.repair_of = r.o_orderkey AND f.fingerprint = r.fingerprint, false) AS ok FROM r LEFT JOIN f USING (o_orderkey))""",
)
def repair_override(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = orders.select("o_orderkey", (key % 4 == 0).alias("failed"), (key % 3).alias("fingerprint"), F.col("o_custkey").alias("value"))
    fixes = orders.where(key % 2 == 0).select("o_orderkey", F.when(key % 5 == 0, -1).otherwise(key).alias("repair_of"), (key % 6 % 3).alias("fingerprint"), (-F.col("o_custkey")).alias("value"))
    return I.repaired(rows, fixes, "o_orderkey")


@query(
    "audit_checks_unpivot",
    """WITH x AS (SELECT d.n_chars = length(d.text) AS length_matches, d.text <> '' AS nonempty, l.doc_id IS NOT NULL AS labelled, l.quality IN (0, 1) AS quality_valid, d.lang IN ('en', 'de') AS known_lang FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT "check", count(*) FILTER (WHERE coalesce(ok, false)) AS passed, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS failed FROM (
      SELECT 'length_matches' AS "check", length_matches AS ok FROM x UNION ALL SELECT 'nonempty', nonempty FROM x UNION ALL SELECT 'labelled', labelled FROM x UNION ALL SELECT 'quality_valid', quality_valid FROM x UNION ALL SELECT 'known_lang', known_lang FROM x) GROUP BY 1""",
)
def audit_checks_unpivot(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left")
    checks = {"length_matches": F.col("n_chars") == F.length("text"), "nonempty": F.col("text") != "", "labelled": F.col("there").isNotNull(), "quality_valid": F.col("quality").isin(0, 1), "known_lang": F.col("lang").isin("en", "de")}
    return I.check_counts(rows, checks)


@query("one_to_one_audit", """SELECT md5(text) AS receipt, count(DISTINCT doc_id) AS uses FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def one_to_one_audit(spark, sf_dir):
    return I.one_to_one(documents(spark, sf_dir).withColumn("receipt", F.md5("text")), "receipt", "doc_id")


@query("fingerprint_groups", """SELECT source, count(DISTINCT lang) AS fingerprints, string_agg(DISTINCT lang, ',' ORDER BY lang) AS names FROM documents GROUP BY source""")
def fingerprint_groups(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.countDistinct("lang").alias("fingerprints"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))


@query(
    "manifest_diff",
    """WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS d FROM documents WHERE doc_id % 5 <> 0), w AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS d FROM documents WHERE doc_id % 3 <> 0)
    SELECT path, CASE WHEN w.d IS NULL THEN 'extra' WHEN h.d IS NULL THEN 'missing' WHEN h.d = w.d THEN 'ok' ELSE 'changed' END AS status FROM h FULL OUTER JOIN w USING (path)""",
)
def manifest_diff(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("digest"))
    want = rows.where("doc_id % 3 <> 0").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("digest")))
    return I.manifest_diff(rows.where("doc_id % 5 <> 0"), want)


@query("dedup_identical", """SELECT lang, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY ALL""")
def dedup_identical(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang", F.md5("text").alias("digest")).agg(F.count("*").alias("copies"))


@query(
    "determinism_except",
    f"""WITH {CHUNKS}, one AS (SELECT doc_id, md5(array_to_string(p[1:64], '')) AS d FROM tok WHERE len(p) > 64), other AS (SELECT doc_id, md5(chunk_text) AS d FROM chunks WHERE chunk_ord = 0 AND token_end = 64)
    SELECT (SELECT count(*) FROM (SELECT * FROM one EXCEPT ALL SELECT * FROM other)) AS only_selected, (SELECT count(*) FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM one)) AS only_chunked""",
)
def determinism_except(spark, sf_dir):
    """One selection made in two ways, compared both ways: the head of 64 pieces, and the first chunk of the grid.

    A text of just 64 pieces has such a chunk and no selection, so the two differ by those.
    """
    docs = documents(spark, sf_dir)
    one = select_all(docs, ["head"], [64]).select("doc_id", F.md5("filtered_text").alias("d"))
    other = chunk_grid(docs).where("chunk_ord = 0 AND token_end = 64").select("doc_id", F.md5("chunk_text").alias("d"))
    both = one.exceptAll(other).select(F.lit(True).alias("selected")).unionByName(other.exceptAll(one).select(F.lit(False).alias("selected")))
    return both.agg(F.count_if("selected").alias("only_selected"), F.count_if(~F.col("selected")).alias("only_chunked"))


@query(
    "stored_selection_gate",
    f"""WITH {TOK}, x AS (SELECT CASE WHEN len(p) = 0 THEN 'selector' WHEN d.n_chars <> length(d.text) THEN 'source_mismatch' WHEN len(p) > 1000 THEN 'budget' WHEN NOT regexp_matches(d.text, '[.!?]') THEN 'reader' END AS error_type FROM tok JOIN documents d USING (doc_id))
    SELECT error_type, count(*) AS n FROM x GROUP BY 1""",
)
def stored_selection_gate(spark, sf_dir):
    """The first gate that a stored selection fails names its error: nothing selected, another source, over budget, nothing to read."""
    rows = documents(spark, sf_dir).select("text", "n_chars", tokens.count(F.col("text")).alias("n"))
    error = F.when(F.col("n") == 0, "selector").when(F.col("n_chars") != F.length("text"), "source_mismatch").when(F.col("n") > 1000, "budget").when(~F.col("text").rlike("[.!?]"), "reader")
    return rows.groupBy(error.alias("error_type")).agg(F.count("*").alias("n"))


@query(
    "legacy_id_rebase",
    """WITH r AS (SELECT doc_id AS example, (doc_id + doc_id % 2) AS source FROM documents), h AS (SELECT doc_id, md5(text) AS d FROM documents)
    SELECT r.example, r.source, coalesce(a.d = b.d, false) AS accepted FROM r LEFT JOIN h a ON a.doc_id = r.example LEFT JOIN h b ON b.doc_id = r.source""",
)
def legacy_id_rebase(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("example"), (F.col("doc_id") + F.col("doc_id") % 2).alias("source"))
    return I.rebased_ids(rows, docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest")))


@query(
    "independent_rescore",
    rf"""WITH {TOK}, {FACTS}, x AS (
      SELECT b <= 128 AS by_span, contains(trim(regexp_replace(array_to_string(p[1:128], ''), '[ \t\n\r\f\v]+', ' ', 'g')), trim(regexp_replace(gold, '[ \t\n\r\f\v]+', ' ', 'g'))) AS by_text FROM facts WHERE len(p) > 128
    ) SELECT count(*) AS n, count(*) FILTER (WHERE by_span) AS by_span, count(*) FILTER (WHERE by_text) AS by_text, count(*) FILTER (WHERE by_span <> by_text) AS disagreements FROM x""",
)
def independent_rescore(spark, sf_dir):
    """Evidence in the head of 128 pieces scored in two ways, by spans and by text: a passage that repeats is found by the second alone."""
    docs = documents(spark, sf_dir)
    facts = planted(docs).select("doc_id", "gold", F.col("token_end").alias("end"))
    rows = verbatim_hits(select_all(docs, ["head"], [128]), facts, ["doc_id"]).select((F.col("end") <= 128).alias("by_span"), F.col("hit").alias("by_text"))
    counts = [F.count_if(c).alias(c) for c in ("by_span", "by_text")]
    return rows.agg(F.count("*").alias("n"), *counts, F.count_if(F.col("by_span") != F.col("by_text")).alias("disagreements"))


@query(
    "sampled_rebuild",
    f"""WITH {CHUNKS}, s AS (SELECT doc_id, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents WHERE text <> ''), parts AS (
      SELECT doc_id, chunk_ord, regexp_extract_all(chunk_text, '[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$') AS q, max(chunk_ord) OVER (PARTITION BY doc_id) AS last FROM chunks WHERE doc_id IN (SELECT doc_id FROM s WHERE r <= 3)
    ), built AS (SELECT doc_id, string_agg(array_to_string(CASE WHEN chunk_ord = last THEN q ELSE q[1:48] END, ''), '' ORDER BY chunk_ord) AS t FROM parts GROUP BY doc_id)
    SELECT doc_id, sha256(t) AS rebuilt_sha256, t = text AS same, length(t) = n_chars AS same_length, contains(t, 'INJECTED-GOLD') AS injected FROM s JOIN built USING (doc_id) WHERE r <= 3""",
)
def sampled_rebuild(spark, sf_dir):
    """Three contexts of each cell, rebuilt from their stored chunks, hashed, compared with the source and searched for injected gold."""
    order = Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    picked = documents(spark, sf_dir).where("text <> ''").withColumn("r", F.row_number().over(order)).where("r <= 3").select("doc_id", "text", "n_chars")
    chunks = chunk_grid(picked).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_ord", "chunk_text"))).alias("chunks"))
    parts = F.transform("chunks", lambda c, k: F.when(k == F.size("chunks") - 1, c["chunk_text"]).otherwise(tokens.decode(tokens.head(tokens.pieces(c["chunk_text"]), F.lit(SIZE - OVERLAP)))))
    rows = chunks.select("doc_id", F.array_join(parts, "").alias("t")).join(picked, "doc_id")
    return rows.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("rebuilt_sha256"), (F.col("t") == F.col("text")).alias("same"), (F.length("t") == F.col("n_chars")).alias("same_length"), F.contains("t", F.lit("INJECTED-GOLD")).alias("injected"))
