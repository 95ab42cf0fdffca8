"""Context selectors: columns or frames that cut a text to a budget of pieces, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import sentences
from tidewater.functions.tokens import count, decode, head, pieces, tail


def full_context(text: Column, parts: Column, budget: Column) -> Column:
    return text


def empty_context(text: Column, parts: Column, budget: Column) -> Column:
    return F.lit("")


def first_pieces(text: Column, parts: Column, budget: Column) -> Column:
    return decode(head(parts, budget))


def last_pieces(text: Column, parts: Column, budget: Column) -> Column:
    return decode(tail(parts, budget))


def both_ends(text: Column, parts: Column, budget: Column) -> Column:
    """Half of the budget, rounded down, from the front, the rest from the end, without a separator; a text that fits is whole."""
    front = F.floor(budget / 2).cast("int")
    return F.when(F.size(parts) <= budget, text).otherwise(F.concat(decode(head(parts, front)), decode(tail(parts, budget - front))))


#: Selectors that are columns of the text and its pieces alone.
SELECTORS: dict[str, Callable[[Column, Column, Column], Column]] = {"full_context": full_context, "empty_context": empty_context, "head": first_pieces, "tail": last_pieces, "head_tail": both_ends}


def select_all(docs: DataFrame, methods: list[str], budgets: list[int]) -> DataFrame:
    """``doc_id, method, budget, source_tokens, filtered_text``: a row per text, method and budget that the text exceeds.

    No shuffle; a text is cut once, for all methods and budgets.
    """
    cells = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(b).alias("budget"), SELECTORS[m](F.col("text"), F.col("p"), F.lit(b)).alias("filtered_text")) for m in methods for b in budgets))
    rows = docs.select("doc_id", "text", pieces(F.col("text")).alias("p"))
    rows = rows.select("doc_id", F.size("p").alias("source_tokens"), F.inline(cells))
    return rows.where("source_tokens > budget").select("doc_id", "method", "budget", "source_tokens", "filtered_text")


def keep_best_pieces(docs: DataFrame, budget: int) -> DataFrame:
    """A compressor's stand-in: the budget's longest pieces, earlier ones of equals, in source order."""
    rows = docs.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "piece"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length(F.trim("piece"))), "pos")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= budget)
    kept = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("kept"))
    return kept.select("doc_id", decode(F.transform("kept", lambda x: x["piece"])).alias("filtered_text"), F.size("kept").alias("selected_tokens"))


def prune_sentences(ranked_chunks: DataFrame, budget: int, least_words: int = 5) -> DataFrame:
    """A pruner's stand-in: chunks lose their short sentences, then a strict prefix of the ranking that fits is put in source order."""
    long = F.filter(sentences(F.col("chunk_text")), lambda x: F.size(F.split(F.trim(x), " +")) >= least_words)
    rows = ranked_chunks.withColumn("pruned", F.array_join(long, " ")).where(F.trim("pruned") != "")
    rows = rows.withColumn("tokens", count(F.col("pruned")))
    order = Window.partitionBy("doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget)
    kept = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ord", "pruned"))).alias("kept"), F.max("used").alias("selected_tokens"))
    return kept.select("doc_id", F.array_join(F.transform("kept", lambda x: x["pruned"]), "\n").alias("filtered_text"), "selected_tokens", F.size("kept").alias("kept_chunks"))
