"""Rankings of chunks for a question: Okapi BM25 within each context, dense dot products, reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.tokens import lexemes
from tidewater.operators.chunking import OVERLAP, SIZE, chunk_array

#: The usual Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(chunks: DataFrame, questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunk spans with ``score`` and ``rank`` of every chunk, for one question (doc_id, query) per context.

    For chunks that are rows of their own: one shuffle gathers a context's chunks in a row, where all the rest happens.
    """
    spans = [c for c in ("token_start", "token_end") if c in chunks.columns]
    row = F.struct("chunk_ord", *spans, lexemes(F.col("chunk_text")).alias("terms"))
    rows = chunks.select(key, row.alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("chunks"))
    return scored(rows.join(questions.select(key, lexemes(F.col("query")).alias("asked")), key), [key], spans)


def bm25_texts(rows: DataFrame, query: Column, keep: list[str], text: bool = False, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``bm25`` over the grid of each row's pieces ``p``, which should not be empty: without any shuffle, and texts are cut once.

    Columns ``keep`` are carried along, and with ``text`` each chunk's text.
    """
    rows = rows.select(*keep, lexemes(query).alias("asked"), chunk_array(F.col("p"), size, overlap).alias("cut"))
    # a chunk's text leaves the row only where it is asked for
    fields = ["chunk_ord", "token_start", "token_end", *["chunk_text"] * text]
    each = F.transform("cut", lambda c: F.struct(*(c[f].alias(f) for f in fields), lexemes(c["chunk_text"]).alias("terms")))
    return scored(rows.select(*keep, "asked", each.alias("chunks")), keep, fields[1:])


def scored(rows: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """Scores and ranks the array ``chunks`` (chunk_ord, fields, terms) for the terms ``asked``, and gives a row per chunk.

    Statistics are those of the row's own chunks. Of the vocabulary only the sum of its weights is needed, which a walk over its sorted
    terms gives; only terms that are asked for are looked at in each chunk. Chunks that share no term keep score 0.
    """
    n, total = F.size("chunks"), F.aggregate("chunks", F.lit(0), lambda acc, c: acc + F.size(c["terms"]))
    raw = lambda df: F.log(F.col("n") - df + 0.5) - F.log(df + 0.5)
    rows = rows.select(
        *keep, "asked", "chunks", n.alias("n"), (total / n).alias("avgdl"), F.array_distinct("asked").alias("words"),
        F.sort_array(F.flatten(F.transform("chunks", lambda c: F.array_distinct(c["terms"])))).alias("sorted"),
    )
    start = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("df"), F.lit(0.0).alias("sum"), F.lit(0).alias("size"))

    def walk(acc: Column, term: Column) -> Column:
        same = acc["term"].eqNullSafe(term)
        passed = F.when(same | (acc["df"] == 0), acc["sum"]).otherwise(acc["sum"] + raw(acc["df"]))
        return F.struct(term.alias("term"), F.when(same, acc["df"] + 1).otherwise(1).alias("df"), passed.alias("sum"), F.when(same, acc["size"]).otherwise(acc["size"] + 1).alias("size"))

    vocabulary = F.aggregate("sorted", start, walk)
    held = F.transform("chunks", lambda c: F.array_intersect(c["terms"], F.col("words")))
    rows = rows.select(*keep, "asked", "chunks", "n", "avgdl", "words", vocabulary.alias("v"), held.alias("held"))
    floor = F.when(F.col("v.size") > 0, EPSILON * (F.col("v.sum") + raw(F.col("v.df"))) / F.col("v.size"))
    rows = rows.withColumn("floor", floor)

    def weight(term: Column) -> Column:
        idf = raw(F.size(F.filter("held", lambda h: F.array_contains(h, term))))
        times = F.size("asked") - F.size(F.array_remove("asked", term))
        return times * F.when(idf < 0, F.col("floor")).otherwise(idf)

    rows = rows.withColumn("weights", F.map_from_arrays("words", F.transform("words", weight)))

    def score(c: Column, k: Column) -> Column:
        dl = F.size(c["terms"])

        def add(acc: Column, term: Column) -> Column:
            tf = dl - F.size(F.array_remove(c["terms"], term))
            return acc + F.col("weights")[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))

        return F.round(F.aggregate(F.get("held", k), F.lit(0.0), add), 6)

    order = F.sort_array(F.transform("chunks", lambda c, k: F.struct((-score(c, k)).alias("minus"), c["chunk_ord"].alias("chunk_ord"), *(c[f].alias(f) for f in fields))))
    rows = rows.select(*keep, F.posexplode(order).alias("place", "c"))
    return rows.select(*keep, "c.chunk_ord", *(f"c.{f}" for f in fields), (0.0 - F.col("c.minus")).alias("score"), (F.col("place") + 1).alias("rank"))


def ranked(rows: DataFrame, key: str = "doc_id", score: str = "score", tie: str = "chunk_ord") -> DataFrame:
    """Adds ``rank`` from 1 by falling score, then rising ``tie``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dense_topk(probes: DataFrame, corpus: DataFrame, k: int, block: int = 4_000, vectors: int = 8_000) -> DataFrame:
    """``probe_id, vec_id, score, rank``: the k nearest of a stated probe set, against all vectors.

    Both sides are dealt by id into blocks, of about ``block`` probes and ``vectors`` vectors, and each block of one meets each of the other
    in a task, as a product of matrices. Whatever could be among the k best there, with the error of that product and the rounding of
    scores, is summed again in the order of ``dot``, so that scores and ties are exact. Vectors that have nulls, values
    beyond 1e100 or that are not finite, or another length than the longest probe, meet the other side as rows.
    """
    length = probes.agg(F.max(F.size("probe"))).first()[0] or 0
    plain = lambda c: F.coalesce((F.size(c) == length) & (length > 0) & F.forall(c, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False))
    corpus, probes = (df.where(f"{i} IS NOT NULL") for df, i in ((corpus, "vec_id"), (probes, "probe_id")))
    own = probes.where(plain("probe"))

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        return some.join(others, F.col("vec_id") != F.col("probe_id")).select("probe_id", "vec_id", dot(F.col("probe"), F.col("embedding")).alias("score"))

    pairs = met(probes.where(~plain("probe")), corpus).unionByName(met(own, corpus.where(~plain("embedding"))))

    across, down = (max(1, -(-df.count() // n)) for df, n in ((corpus, vectors), (probes, block)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select(part("probe_id", down).alias("p"), each(across).alias("v"), F.lit(True).alias("asks"), F.col("probe_id").cast("long").alias("id"), F.col("probe").cast("array<double>").alias("x"))
    right = corpus.where(plain("embedding")).select(each(down).alias("p"), part("vec_id", across).alias("v"), F.lit(False).alias("asks"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, x = table["id"].to_numpy(), table["x"].combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
        (mine, a), (theirs, b) = ((ids[asks], x[asks]), (ids[~asks], x[~asks]))
        order = np.argsort(theirs, kind="stable")
        theirs, b = theirs[order], b[order]
        longest = np.sqrt((b * b).sum(1).max(initial=0))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for start in range(0, len(mine) if len(theirs) else 0, 128):
            scores = a[start : start + 128] @ b.T
            scores[mine[start : start + 128, None] == theirs] = -np.inf
            least = np.partition(scores, len(theirs) - k, axis=1)[:, len(theirs) - k] if len(theirs) > k else np.full(len(scores), -np.inf)
            for i, (row, low) in enumerate(zip(scores, least.tolist(), strict=True), start):
                error = 1e-15 * x.shape[1] * np.sqrt((a[i] * a[i]).sum()) * longest
                j = np.flatnonzero((row >= low - 1.1e-5 - 2 * error) & (row > -np.inf))
                score = np.zeros(len(j))
                for d in range(x.shape[1]):
                    score += a[i, d] * b[j, d]
                # equal scores stand by id: no more than k of them are needed
                best = np.lexsort((theirs[j], -score))
                j, score = j[best], score[best]
                begins = np.searchsorted(-score, -score, "left")
                keep = np.arange(len(j)) - begins < k
                out.append((np.full(keep.sum(), mine[i]), theirs[j[keep]], score[keep]))
        return pa.table(dict(zip(("probe_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.unionByName(right).groupBy("p", "v").applyInArrow(run, "probe_id long, vec_id long, score double")
    kinds = {"probe_id": probes.schema["probe_id"].dataType, "vec_id": corpus.schema["vec_id"].dataType}
    found = found.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), "score")
    rows = found.unionByName(pairs).withColumn("score", F.round("score", 5))
    return ranked(rows, "probe_id", "score", "vec_id").where(F.col("rank") <= k)


def rerank(candidates: DataFrame, second: Column, key: str = "probe_id") -> DataFrame:
    """Candidates in the order of a second score; equal ones keep the order they had. Nothing else is added."""
    rows = candidates.withColumn("second_score", F.round(second, 6))
    return rows.withColumn("second_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("second_score"), "rank")))


def candidates_needed(candidates: int, budget: int, size: int) -> int:
    """How many to rescore: as many as are asked for, or as a budget could hold of chunks of ``size`` and eight more."""
    return max(candidates, -(-budget // size) + 8)


def yes_share(yes: Column, no: Column) -> Column:
    """Softmax of a yes and a no logit."""
    return 1 / (1 + F.exp(no - yes))
