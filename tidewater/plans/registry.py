"""Registered queries: each a function of (spark, sf_dir), with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Common table expressions of the SQL side.
TOK = r"""tok AS (
  SELECT doc_id, text, lang, source, regexp_extract_all(text, '[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$') AS p FROM documents
)"""
CHUNKS = TOK + """, grid AS (
  SELECT doc_id, p, unnest(range(0, greatest(CAST(ceil((len(p) - 64) / 48.0) AS BIGINT), 0) + 1)) AS chunk_ord FROM tok WHERE len(p) > 0
), chunks AS (
  SELECT doc_id, CAST(chunk_ord AS INTEGER) AS chunk_ord, CAST(chunk_ord * 48 AS INTEGER) AS token_start,
         CAST(least(chunk_ord * 48 + 64, len(p)) AS INTEGER) AS token_end,
         array_to_string(p[chunk_ord * 48 + 1 : least(chunk_ord * 48 + 64, len(p))], '') AS chunk_text
  FROM grid
)"""
QUESTIONS = """questions AS (
  SELECT d.doc_id, b.text AS query FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
)"""
BM25 = CHUNKS + ", " + QUESTIONS + """, lex AS (
  SELECT doc_id, chunk_ord, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS terms FROM chunks
), stats AS (
  SELECT doc_id, count(*) AS n, avg(len(terms)) AS avgdl FROM lex GROUP BY doc_id
), tf AS (
  SELECT doc_id, chunk_ord, dl, term, count(*) AS tf
  FROM (SELECT doc_id, chunk_ord, len(terms) AS dl, unnest(terms) AS term FROM lex) GROUP BY ALL
), raw AS (
  SELECT doc_id, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw
  FROM (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL) JOIN stats USING (doc_id)
), idf AS (
  SELECT doc_id, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY doc_id) ELSE raw END AS idf FROM raw
), asked AS (
  SELECT doc_id, term, count(*) AS qtf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM questions) GROUP BY ALL
), hits AS (
  SELECT doc_id, chunk_ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN idf USING (doc_id, term) JOIN tf USING (doc_id, term) GROUP BY ALL
), scored AS (
  SELECT c.*, coalesce(score, 0) AS score FROM chunks c LEFT JOIN hits USING (doc_id, chunk_ord) WHERE doc_id IN (SELECT doc_id FROM questions)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_ord) AS rank FROM scored
)"""
BUDGETS = [64, 128, 256]
BUDGET_ROWS = "(VALUES (64), (128), (256)) b(budget)"
