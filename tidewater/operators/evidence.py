"""Whether annotated evidence survives a selection: covered spans, or verbatim text; by fact, turn and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import holds
from tidewater.functions.tokens import pieces

#: Methods whose selections are rewritten text, so that only verbatim scoring applies.
REWRITING = ("llmlingua2", "provence")


def span_hits(selected: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows (keys, token_start, token_end) with ``hit``: one merged selected span (keys + extra, s, e) contains it.

    A duplicate of the evidence elsewhere doesn't count. The join is on the keys; the range is a filter within them.
    """
    extra = [c for c in selected.columns if c not in (*keys, "s", "e")]
    lists = selected.groupBy(*keys, *extra).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    inside = F.exists("spans", lambda x: (x["s"] <= F.col("token_start")) & (x["e"] >= F.col("token_end"))) & (F.col("token_end") > F.col("token_start"))
    return lists.join(evidence, keys).withColumn("hit", inside).drop("spans")


def verbatim_hits(selections: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows (keys, gold) with ``hit``: the selected text contains the gold text, white space aside."""
    return selections.join(evidence, keys).withColumn("hit", holds(F.col("filtered_text"), F.col("gold")))


def recall(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``fraction_retained, all_retained, n_support`` per selection."""
    return hits.groupBy(*keys).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("fraction_retained"), F.bool_and("hit").alias("all_retained"), F.count("*").alias("n_support"))


def session_recall(hits: DataFrame, keys: list[str], session: str = "session") -> DataFrame:
    """Share of the sessions with an annotated turn of which a turn survives."""
    return hits.groupBy(*keys).agg(
        F.round(F.countDistinct(F.when(F.col("hit"), F.col(session))) / F.countDistinct(session), 6).alias("session_recall"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("turn_recall"),
        F.countDistinct(session).alias("n_sessions"),
    )


def set_metrics(gold: Column, chosen: Column) -> dict[str, Column]:
    """Recall (null without gold), precision (0 without a selection), F1 and whether all gold is chosen."""
    both = F.size(F.array_intersect(gold, chosen))
    r = both / F.nullif(F.size(F.array_distinct(gold)), F.lit(0))
    p = F.coalesce(both / F.nullif(F.size(F.array_distinct(chosen)), F.lit(0)), F.lit(0.0))
    return {"recall": r, "precision": p, "f1": F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), "all_retained": F.size(F.array_except(gold, chosen)) == 0}


def route(method: Column, complete: Column, whole_chunks: Column, redecodes: Column) -> Column:
    """How a selection is scored: span, verbatim or an error."""
    return (
        F.when(~complete, F.lit("error"))
        .when(method.isin(*REWRITING), F.lit("verbatim"))
        .when(whole_chunks | redecodes, F.lit("span"))
        .otherwise(F.lit("verbatim"))
    )


def annotation_status() -> Column:
    """Of an annotation (review, reviewer, source_sha256, context, char_start, char_end, quoted): ok, or the first thing that is wrong."""
    own = F.sha2(F.col("context").cast("binary"), 256)
    found = F.substring(F.col("context"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return (
        F.when(~F.col("review").eqNullSafe(F.lit("reviewed")), "not_reviewed")
        .when(F.coalesce("reviewer", F.lit("")) == "", "no_reviewer")
        .when(~F.col("source_sha256").eqNullSafe(own), "source_changed")
        .when(F.coalesce("quoted", F.lit("")) == "", "no_support")
        .when(found != F.col("quoted"), "span_mismatch")
        .otherwise("ok")
    )


def planted(docs: DataFrame, at: float = 1 / 3, length: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence with known truth: ``length`` pieces from a fixed share of each text, with token and character spans.

    ``keep`` may name ``p``, the text's pieces.
    """
    rows = docs.where(F.length("text") > 0).select("doc_id", "lang", pieces(F.col("text")).alias("p"))
    rows = rows.withColumn("token_start", F.floor(F.size("p") * at).cast("int")).withColumn("token_end", F.least(F.col("token_start") + length, F.size("p")))
    before = F.array_join(F.slice("p", F.lit(1), F.col("token_start")), "")
    gold = F.array_join(F.slice("p", F.col("token_start") + 1, F.col("token_end") - F.col("token_start")), "")
    return rows.select("doc_id", "lang", "token_start", "token_end", F.length(before).alias("char_start"), (F.length(before) + F.length(gold)).alias("char_end"), gold.alias("gold"), *keep)
