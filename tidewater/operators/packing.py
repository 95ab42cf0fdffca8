"""Packing a ranking under a budget: strict prefixes by concatenation or by the union of source spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, 0)


def pack_concat(ranked_chunks: DataFrame, budgets: list[int], key: str = "doc_id") -> DataFrame:
    """Ranked chunks (with token_start, token_end) that fit: each costs its pieces, and a separator after the first.

    Costs only grow along the ranking, so the prefix is a filter on a running sum.
    """
    cost = F.col("token_end") - F.col("token_start") + (F.col("rank") > 1).cast("int")
    rows = ranked_chunks.withColumn("used", F.sum(cost).over(Window.partitionBy(key).orderBy("rank").rowsBetween(*RUNNING)))
    return rows.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("used <= budget")


def pack_skip(ranked_chunks: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """The other policy: a chunk that doesn't fit is skipped and later ones are tried. Order-dependent, hence a fold per context."""
    rows = ranked_chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_ord", (F.col("token_end") - F.col("token_start")).alias("n")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["chunk_ord"]))).otherwise(acc["kept"]).alias("kept"))

    return rows.select(key, F.aggregate("all", start, step).alias("x")).select(key, "x.used", F.array_sort("x.kept").alias("kept"))


def render(packed: DataFrame, order: str = "chunk_ord", keys: tuple[str, ...] = ("doc_id", "budget")) -> DataFrame:
    """Text of packed chunks in source (``chunk_ord``) or rank order, joined by a newline."""
    kept = packed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "chunk_text"))).alias("kept"), F.count("*").alias("kept_chunks"), F.max("used").alias("selected_tokens"))
    return kept.select(*keys, "kept_chunks", "selected_tokens", F.array_join(F.transform("kept", lambda x: x["chunk_text"]), "\n").alias("filtered_text"))


def union_costs(ranked_chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``union_tokens`` and ``union_spans``: size and number of spans of the union of a chunk and all that rank before it.

    The token line is cut into elementary cells, each with the best rank that covers it. On a grid whose overlap is at most
    its step a cell is covered by one chunk or by two neighbours, so cells come from a window over neighbours. What a cell adds
    to the union stands beside the ranked rows themselves, and a running sum over ranks gives both costs: the ranking is read once
    and dealt out once, and no chunk is compared with more than its neighbours.
    """
    line = Window.partitionBy(key).orderBy("token_start")
    names = ranked_chunks.columns
    rows = ranked_chunks.select(key, F.struct(*names).alias("own"), "token_start", "token_end", "rank")
    rows = rows.withColumns({"before_end": F.lag("token_end").over(line), "before_rank": F.lag("rank").over(line), "next_start": F.lead("token_start").over(line)})
    shared_to = F.greatest(F.least(F.coalesce("before_end", "token_start"), F.col("token_end")), F.col("token_start"))
    own_to = F.greatest(F.coalesce(F.least("next_start", "token_end"), F.col("token_end")), shared_to)
    nothing = F.lit(None)
    cell = lambda s, e, m, own: F.struct(s.alias("s"), e.alias("e"), m.alias("m"), own.alias("own"))
    no_chunk = F.when(F.lit(False), F.col("own"))
    cells = F.array(
        cell(F.col("token_start"), shared_to, F.least("rank", "before_rank"), no_chunk),
        cell(shared_to, own_to, F.col("rank"), no_chunk),
        cell(F.col("token_end"), nothing.cast("int"), F.col("rank"), F.col("own")),  # the chunk itself, which is no cell
    )
    cells = rows.select(key, F.explode(cells).alias("c")).select(key, "c.*").where("e > s OR own IS NOT NULL")
    walk = Window.partitionBy(key).orderBy("s", F.col("e").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("own").isNull(), F.struct("e", "m")), ignorenulls=True).over(walk)
    cells = cells.withColumn("last", last).withColumn("left", F.when(F.col("last.e") == F.col("s"), F.col("last.m")))
    opens = F.coalesce(F.col("m") < F.col("left"), F.lit(True))
    change = lambda rank, dt, ds, own: F.struct(rank.alias("at"), dt.cast("int").alias("dt"), ds.cast("int").alias("ds"), own.alias("own"))
    changes = F.when(F.col("own").isNotNull(), F.array(change(F.col("m"), F.lit(0), F.lit(0), F.col("own")))).otherwise(
        F.filter(F.array(change(F.col("m"), F.col("e") - F.col("s"), opens, no_chunk), change(F.when(opens, F.col("left")), F.lit(0), F.lit(-1), no_chunk)), lambda x: x["at"].isNotNull())
    )
    rows = cells.select(key, F.explode(changes).alias("x")).select(key, "x.*")
    running = Window.partitionBy(key).orderBy("at").rangeBetween(*RUNNING)
    rows = rows.withColumn("union_tokens", F.sum("dt").over(running)).withColumn("union_spans", F.sum("ds").over(running))
    return rows.where("own IS NOT NULL").select("own.*", "union_tokens", "union_spans")


def pack_union(ranked_chunks: DataFrame, budgets: list[int], joiner_costs: bool = False, key: str = "doc_id") -> DataFrame:
    """Ranked chunks whose union fits. With the piece tokenizer a joining newline costs nothing; else each costs one."""
    cost = F.col("union_tokens") + (F.greatest(F.col("union_spans") - 1, F.lit(0)) if joiner_costs else F.lit(0))
    return union_costs(ranked_chunks, key).withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where(cost <= F.col("budget"))
