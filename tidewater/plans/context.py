"""Queries over tokens, chunks, selectors and packers: a text is an example's context, a benchmark item its question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import spans, tokens
from tidewater.operators.layout import spread
from tidewater.operators.chunking import chunk_grid, chunk_ids
from tidewater.operators.packing import pack_concat, pack_skip, pack_union, render, union_costs
from tidewater.operators.ranking import bm25_texts, dense_topk, rerank
from tidewater.operators.selectors import keep_best_pieces, prune_sentences, select_all
from tidewater.plans.registry import BM25, BUDGET_ROWS, BUDGETS, CHUNKS, TOK, query, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def digest(name: str) -> F.Column:
    return F.sha2(F.col(name).cast("binary"), 256)


def ranking(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Chunks with their BM25 scores and ranks, and their texts where they are asked for.

    A document's question is a benchmark item, in turn. The items are counted and few; Spark picks the join by their size.
    """
    items = table(spark, sf_dir, "benchmark")
    asked = F.pmod("doc_id", F.lit(items.count())).alias("item_id")
    docs = documents(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "text", asked)
    docs = docs.join(items.select("item_id", F.col("text").alias("query")), "item_id")
    return bm25_texts(docs.select("doc_id", "query", tokens.pieces(F.col("text")).alias("p")), F.col("query"), ["doc_id"], text)


@query("tok_piece_counts", f"WITH {TOK} SELECT doc_id, len(p) AS n_pieces, length(text) AS n_chars, strlen(text) AS n_bytes FROM tok")
def tok_piece_counts(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tokens.count(text).cast("long").alias("n_pieces"), F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"))


@query(
    "tok_char_offsets",
    f"""WITH {TOK}, x AS (
      SELECT doc_id, unnest(range(len(p))) AS piece_ord, unnest(p) AS piece FROM tok
    ), y AS (
      SELECT doc_id, piece_ord, sum(length(piece)) OVER w AS char_end, length(piece) AS n, sum(strlen(piece)) OVER w AS byte_end, strlen(piece) AS b
      FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY piece_ord)
    ) SELECT doc_id, CAST(piece_ord AS INTEGER) AS piece_ord, CAST(char_end - n AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
             CAST(byte_end - b AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM y""",
)
def tok_char_offsets(spark, sf_dir):
    return tokens.piece_offsets(documents(spark, sf_dir))


@query("tok_roundtrip", f"WITH {TOK} SELECT doc_id, array_to_string(p, '') = text AS same, sha256(array_to_string(p, '')) AS rebuilt FROM tok")
def tok_roundtrip(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", tokens.decode(tokens.pieces(F.col("text"))).alias("rebuilt"))
    return rows.select("doc_id", (F.col("rebuilt") == F.col("text")).alias("same"), digest("rebuilt").alias("rebuilt"))


@query(
    "tok_native_audit",
    f"WITH {CHUNKS} SELECT max(strlen(chunk_text)) AS longest, count(*) FILTER (WHERE strlen(chunk_text) > 400) AS over_limit, count(*) AS n_chunks FROM chunks",
)
def tok_native_audit(spark, sf_dir):
    """Lengths of chunks under a second tokenizer (bytes), and how many pass a model's limit."""
    n = F.octet_length("chunk_text").cast("long")
    return chunk_grid(documents(spark, sf_dir)).agg(F.max(n).alias("longest"), F.count_if(n > 400).alias("over_limit"), F.count("*").alias("n_chunks"))


@query(
    "tok_registry",
    rf"""WITH {TOK} SELECT tokenizer, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS longest FROM (
      SELECT 'piece' AS tokenizer, len(p) AS n FROM tok UNION ALL SELECT 'bytes', strlen(text) FROM tok UNION ALL SELECT 'chars', length(text) FROM tok
      UNION ALL SELECT 'lexeme', len(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM tok) GROUP BY tokenizer""",
)
def tok_registry(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).cast("long").alias("n")) for k, f in tokens.TOKENIZERS.items())))
    return documents(spark, sf_dir).select(each.alias("x")).select("x.*").groupBy("tokenizer").agg(F.sum("n").alias("total"), F.max("n").alias("longest"))


@query("tok_clip", f"WITH {TOK} SELECT doc_id, sha256(array_to_string(p[1:100], '')) AS clipped_sha256, len(p) > 100 AS clipped FROM tok")
def tok_clip(spark, sf_dir):
    text, clipped = tokens.clip(F.col("text"), F.lit(100))
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.cast("binary"), 256).alias("clipped_sha256"), clipped.alias("clipped"))


@query("chunk_grid", f"WITH {CHUNKS} SELECT doc_id, chunk_ord, token_start, token_end, sha256(chunk_text) AS text_sha256, concat(doc_id, '::', chunk_ord) AS chunk_id FROM chunks")
def chunk_grid_query(spark, sf_dir):
    return chunk_ids(documents(spark, sf_dir)).select("doc_id", "chunk_ord", "token_start", "token_end", digest("chunk_text").alias("text_sha256"), "chunk_id")


@query(
    "chunk_token_spans",
    f"""WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_end - token_start) AS BIGINT) AS total_tokens, max(token_end) AS last_token FROM chunks GROUP BY doc_id""",
)
def chunk_token_spans(spark, sf_dir):
    rows = chunk_grid(documents(spark, sf_dir)).groupBy("doc_id")
    return rows.agg(F.count("*").alias("n_chunks"), F.sum(F.col("token_end") - F.col("token_start")).alias("total_tokens"), F.max("token_end").alias("last_token"))


SELECTED = """SELECT doc_id, method, CAST(budget AS INTEGER) AS budget, CAST(len(p) AS INTEGER) AS source_tokens, sha256(t) AS text_sha256 FROM (
  {parts}
) x JOIN tok USING (doc_id)"""


def selected(spark, sf_dir, methods):
    return select_all(documents(spark, sf_dir), methods, BUDGETS).select("doc_id", "method", "budget", "source_tokens", digest("filtered_text").alias("text_sha256"))


def part(method: str, text: str) -> str:
    return f"SELECT doc_id, '{method}' AS method, budget, {text} AS t FROM tok, {BUDGET_ROWS} WHERE len(p) > budget"


HEAD, TAIL = "array_to_string(p[1:budget], '')", "array_to_string(p[len(p) - budget + 1:], '')"
ENDS = "array_to_string(p[1:budget // 2], '') || array_to_string(p[len(p) - (budget - budget // 2) + 1:], '')"


@query("trunc_head", f"WITH {TOK} " + SELECTED.format(parts=part("head", HEAD)))
def trunc_head(spark, sf_dir):
    return selected(spark, sf_dir, ["head"])


@query("trunc_tail", f"WITH {TOK} " + SELECTED.format(parts=part("tail", TAIL)))
def trunc_tail(spark, sf_dir):
    return selected(spark, sf_dir, ["tail"])


@query("trunc_head_tail", f"WITH {TOK} " + SELECTED.format(parts=part("head_tail", ENDS)))
def trunc_head_tail(spark, sf_dir):
    return selected(spark, sf_dir, ["head_tail"])


@query("control_full_empty", f"WITH {TOK} " + SELECTED.format(parts=part("full_context", "text") + " UNION ALL " + part("empty_context", "''")))
def control_full_empty(spark, sf_dir):
    return selected(spark, sf_dir, ["full_context", "empty_context"])


@query("bm25_per_context", f"WITH {BM25} SELECT doc_id, chunk_ord, CAST(score AS DOUBLE) AS score, rank FROM ranked")
def bm25_per_context(spark, sf_dir):
    return ranking(spark, sf_dir).select("doc_id", "chunk_ord", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_rank_topk", f"WITH {BM25} SELECT doc_id, chunk_ord, CAST(score AS DOUBLE) AS score, rank FROM ranked WHERE rank <= 3")
def bm25_rank_topk(spark, sf_dir):
    return ranking(spark, sf_dir).where("rank <= 3").select("doc_id", "chunk_ord", "score", F.col("rank").cast("long").alias("rank"))


PACKED = BM25 + f""", costs AS (
  SELECT *, sum(token_end - token_start + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rank) AS used FROM ranked
), packed AS (
  SELECT costs.*, b.budget FROM costs, {BUDGET_ROWS} WHERE used <= b.budget
)"""


@query(
    "bm25_pack",
    f"""WITH {PACKED} SELECT CAST(budget AS INTEGER) AS budget, count(DISTINCT doc_id) AS examples, count(*) AS chunks, CAST(sum(token_end - token_start) AS BIGINT) AS tokens,
        round(avg(score), 4) AS mean_score FROM packed GROUP BY budget""",
)
def bm25_pack(spark, sf_dir):
    """The flagship: chunk, rank by BM25, pack under each budget, sum up."""
    return pack_concat(ranking(spark, sf_dir), BUDGETS).groupBy("budget").agg(
        F.countDistinct("doc_id").alias("examples"), F.count("*").alias("chunks"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.round(F.avg("score"), 4).alias("mean_score")
    )


def pack_sql(order: str) -> str:
    return f"""WITH {PACKED} SELECT doc_id, CAST(budget AS INTEGER) AS budget, count(*) AS kept_chunks, CAST(max(used) AS BIGINT) AS selected_tokens,
      sha256(string_agg(chunk_text, chr(10) ORDER BY {order})) AS text_sha256 FROM packed GROUP BY doc_id, budget"""


def pack_query(spark, sf_dir, order):
    out = render(pack_concat(ranking(spark, sf_dir, True), BUDGETS), order)
    return out.select("doc_id", "budget", "kept_chunks", F.col("selected_tokens").cast("long").alias("selected_tokens"), digest("filtered_text").alias("text_sha256"))


@query("pack_concat", pack_sql("chunk_ord"))
def pack_concat_query(spark, sf_dir):
    return pack_query(spark, sf_dir, "chunk_ord")


@query("pack_rank_order", pack_sql("rank"))
def pack_rank_order(spark, sf_dir):
    return pack_query(spark, sf_dir, "rank")


#: The SQL side cuts the token line at every chunk edge and joins cells to the chunks that cover them.
CELLS = BM25 + """, edges AS (
  SELECT doc_id, token_start AS x FROM ranked UNION SELECT doc_id, token_end FROM ranked
), line AS (
  SELECT doc_id, x AS s, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS e FROM edges
), cells AS (
  SELECT l.doc_id, s, e, min(rank) AS m FROM line l JOIN ranked r ON r.doc_id = l.doc_id AND r.token_start <= s AND r.token_end >= e WHERE e IS NOT NULL GROUP BY ALL
), walk AS (
  SELECT *, lag(m) OVER (PARTITION BY doc_id ORDER BY s) AS left_m FROM cells
), deltas AS (
  SELECT doc_id, m AS rank, e - s AS dt, CASE WHEN left_m IS NULL OR m < left_m THEN 1 ELSE 0 END AS ds FROM walk
  UNION ALL SELECT doc_id, left_m, 0, -1 FROM walk WHERE m < left_m
), sums AS (
  SELECT r.doc_id, r.chunk_ord, r.rank, sum(coalesce(dt, 0)) OVER w AS union_tokens, sum(coalesce(ds, 0)) OVER w AS union_spans
  FROM ranked r LEFT JOIN (SELECT doc_id, rank, sum(dt) AS dt, sum(ds) AS ds FROM deltas GROUP BY ALL) d USING (doc_id, rank)
  WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.rank)
)"""


@query("pack_union_costs", f"WITH {CELLS} SELECT doc_id, chunk_ord, rank, CAST(union_tokens AS BIGINT) AS union_tokens, CAST(union_spans AS BIGINT) AS union_spans FROM sums")
def pack_union_costs(spark, sf_dir):
    rows = union_costs(ranking(spark, sf_dir))
    return rows.select("doc_id", "chunk_ord", F.col("rank").cast("long").alias("rank"), "union_tokens", "union_spans")


@query(
    "pack_union_cells",
    f"""WITH {CELLS} SELECT doc_id, CAST(budget AS INTEGER) AS budget, count(*) AS kept_chunks, CAST(max(union_tokens) AS BIGINT) AS selected_tokens,
    CAST(max_by(union_spans, rank) AS BIGINT) AS n_spans FROM sums, {BUDGET_ROWS} WHERE union_tokens <= budget GROUP BY doc_id, budget""",
)
def pack_union_cells(spark, sf_dir):
    rows = pack_union(ranking(spark, sf_dir), BUDGETS).groupBy("doc_id", "budget")
    return rows.agg(F.count("*").alias("kept_chunks"), F.max("union_tokens").alias("selected_tokens"), F.max_by("union_spans", "rank").alias("n_spans"))


@query("pack_union_joiner", f"WITH {CELLS} SELECT doc_id, CAST(budget AS INTEGER) AS budget, count(*) AS kept_chunks FROM sums, {BUDGET_ROWS} WHERE union_tokens + greatest(union_spans - 1, 0) <= budget GROUP BY doc_id, budget")
def pack_union_joiner(spark, sf_dir):
    return pack_union(ranking(spark, sf_dir), BUDGETS, True).groupBy("doc_id", "budget").agg(F.count("*").alias("kept_chunks"))


@query(
    "pack_validate",
    f"""WITH {PACKED}, spans AS (
      SELECT doc_id, budget, chunk_ord, token_start, token_end, CASE WHEN token_start <= max(token_end) OVER (PARTITION BY doc_id, budget ORDER BY chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM packed
    ), islands AS (
      SELECT *, sum(fresh) OVER (PARTITION BY doc_id, budget ORDER BY chunk_ord) AS island FROM spans
    ), merged AS (
      SELECT doc_id, budget, min(token_start) AS s, max(token_end) AS e FROM islands GROUP BY doc_id, budget, island
    ), texts AS (
      SELECT doc_id, budget, s, e, array_to_string(p[s + 1:e], '') AS t FROM merged JOIN tok USING (doc_id)
    ) SELECT doc_id, CAST(budget AS INTEGER) AS budget, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_tokens, sha256(string_agg(t, chr(10) ORDER BY s)) AS text_sha256 FROM texts GROUP BY doc_id, budget""",
)
def pack_validate(spark, sf_dir):
    """The union of packed spans and its rendering: merged spans in order, joined by a newline."""
    packed = pack_concat(ranking(spark, sf_dir), BUDGETS).select("doc_id", "budget", F.col("token_start").alias("s"), F.col("token_end").alias("e"))
    merged = spans.merge_rows(packed, ["doc_id", "budget"]).groupBy("doc_id", "budget").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    rows = merged.join(documents(spark, sf_dir).select("doc_id", tokens.pieces(F.col("text")).alias("p")), "doc_id")
    text = F.array_join(F.transform("spans", lambda x: tokens.decode(F.slice("p", x["s"] + 1, x["e"] - x["s"]))), "\n")
    return rows.select("doc_id", "budget", F.size("spans").cast("long").alias("n_spans"), spans.length(F.col("spans")).cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


@query(
    "pack_skip",
    f"""WITH RECURSIVE {BM25}, pack AS (
      SELECT doc_id, 0::BIGINT AS step, 0::BIGINT AS used, CAST([] AS INTEGER[]) AS kept FROM (SELECT DISTINCT doc_id FROM ranked)
      UNION ALL
      SELECT p.doc_id, p.step + 1, CASE WHEN p.used + r.token_end - r.token_start <= 128 THEN p.used + r.token_end - r.token_start ELSE p.used END,
             CASE WHEN p.used + r.token_end - r.token_start <= 128 THEN list_append(p.kept, r.chunk_ord) ELSE p.kept END
      FROM pack p JOIN ranked r ON r.doc_id = p.doc_id AND r.rank = p.step + 1
    ) SELECT doc_id, max_by(used, step) AS used, list_sort(max_by(kept, step)) AS kept FROM pack GROUP BY doc_id""",
)
def pack_skip_query(spark, sf_dir):
    """Greedy packing that goes on after a miss."""
    return pack_skip(ranking(spark, sf_dir), 128)


@query(
    "span_merge",
    f"""WITH {BM25}, spans AS (
      SELECT doc_id, token_start AS s, token_end AS e FROM ranked WHERE rank <= 5
    ), marked AS (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans
    ), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM marked)
    SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island""",
)
def span_merge(spark, sf_dir):
    top = ranking(spark, sf_dir).where("rank <= 5").select("doc_id", F.col("token_start").alias("s"), F.col("token_end").alias("e"))
    return spans.merge_rows(top, ["doc_id"])


@query(
    "span_merge_array",
    f"""WITH {BM25}, x AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(range(token_start, token_end)) AS t FROM ranked WHERE rank <= 5) GROUP BY ALL)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS union_tokens, CAST(count(*) FILTER (WHERE gap) AS INTEGER) AS n_spans
    FROM (SELECT doc_id, t, coalesce(t - lag(t) OVER (PARTITION BY doc_id ORDER BY t) > 1, true) AS gap FROM x) GROUP BY doc_id""",
)
def span_merge_array(spark, sf_dir):
    top = ranking(spark, sf_dir).where("rank <= 5").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("token_start").alias("s"), F.col("token_end").alias("e"))).alias("x"))
    merged = top.select("doc_id", spans.merge_array(F.col("x")).alias("m"))
    return merged.select("doc_id", spans.length(F.col("m")).alias("union_tokens"), F.size("m").alias("n_spans"))


DENSE = """pairs AS (
  SELECT q.vec_id AS probe_id, c.vec_id, c.label AS label, q.label AS probe_label,
         round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda x: x[1] * x[2])), 5) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), dense AS (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)"""


def nearest(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    probes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"), F.col("label").alias("probe_label"))
    return dense_topk(probes, vectors.select("vec_id", "embedding"), k), probes, vectors


@query("dense_topk", f"WITH {DENSE} SELECT probe_id, vec_id, score, rank FROM dense WHERE rank <= 10")
def dense_topk_query(spark, sf_dir):
    return nearest(spark, sf_dir, 10)[0].withColumn("rank", F.col("rank").cast("long"))


@query(
    "dense_rerank_two_stage",
    f"""WITH {DENSE}, second AS (
      SELECT probe_id, vec_id, rank, round(score * 0.5 + CASE WHEN label = probe_label THEN 0.25 ELSE 0 END, 6) AS second_score FROM dense WHERE rank <= 20
    ), both_ranks AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY second_score DESC, rank) AS second_rank FROM second)
    SELECT probe_id, vec_id, second_score, second_rank FROM both_ranks WHERE second_rank <= 5""",
)
def dense_rerank_two_stage(spark, sf_dir):
    """The best 20 by dot product, rescored by a linear stand-in for a cross-encoder, stable."""
    top, probes, vectors = nearest(spark, sf_dir, 20)
    rows = top.join(vectors.select("vec_id", "label"), "vec_id").join(probes.select("probe_id", "probe_label"), "probe_id")
    rows = rerank(rows, F.col("score") * 0.5 + F.when(F.col("label") == F.col("probe_label"), 0.25).otherwise(0.0))
    return rows.where("second_rank <= 5").select("probe_id", "vec_id", "second_score", F.col("second_rank").cast("long").alias("second_rank"))


@query(
    "compress_topb_tokens",
    rf"""WITH {TOK}, x AS (
      SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS piece FROM tok
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(trim(piece)) DESC, pos) AS r FROM x
    ) SELECT doc_id, CAST(count(*) AS INTEGER) AS selected_tokens, sha256(string_agg(piece, '' ORDER BY pos)) AS text_sha256 FROM r WHERE r <= 64 GROUP BY doc_id""",
)
def compress_topb_tokens(spark, sf_dir):
    return keep_best_pieces(documents(spark, sf_dir), 64).select("doc_id", "selected_tokens", digest("filtered_text").alias("text_sha256"))


@query(
    "prune_sentences_pack",
    rf"""WITH {BM25}, cut AS (
      SELECT doc_id, chunk_ord, rank, array_to_string(list_filter(string_split(regexp_replace(chunk_text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)),
             lambda x: len(string_split_regex(trim(x), ' +')) >= 5), ' ') AS pruned FROM ranked
    ), counted AS (
      SELECT *, len(regexp_extract_all(pruned, '[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$')) AS tokens FROM cut WHERE trim(pruned) <> ''
    ), running AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY rank) AS used FROM counted)
    SELECT doc_id, CAST(max(used) AS BIGINT) AS selected_tokens, CAST(count(*) AS INTEGER) AS kept_chunks, sha256(string_agg(pruned, chr(10) ORDER BY chunk_ord)) AS text_sha256
    FROM running WHERE used <= 128 GROUP BY doc_id""",
)
def prune_sentences_pack(spark, sf_dir):
    rows = prune_sentences(ranking(spark, sf_dir, True), 128)
    return rows.select("doc_id", F.col("selected_tokens").cast("long").alias("selected_tokens"), "kept_chunks", digest("filtered_text").alias("text_sha256"))
