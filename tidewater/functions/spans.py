"""Algebra of half-open spans, on arrays of ``struct<s, e>`` and on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_array(spans: Column) -> Column:
    """Union of an array of spans: touching ones merge, empty ones go, reversed or negative ones raise."""
    bad = F.exists(spans, lambda x: (x["s"] < 0) | (x["e"] < x["s"]))
    kind = "array<struct<s:int,e:int>>"
    clean = F.array_sort(F.filter(spans, lambda x: x["e"] > x["s"]).cast(kind))

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["e"] >= x["s"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.when(bad, F.raise_error(F.lit("a span is negative or reversed")).cast(kind)).otherwise(F.aggregate(clean, F.array().cast(kind), add))


def merge_rows(rows: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """``keys, s, e``: union of spans that are rows, by gaps and islands. One shuffle on the keys."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where(F.col(end) > F.col(start)).withColumn("fresh", F.coalesce((reach < F.col(start)).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias("s"), F.max(end).alias("e")).drop("island")


def covers(spans: Column, start: Column, end: Column) -> Column:
    """Whether one merged span contains [start, end); an empty span is never covered."""
    return (end > start) & F.exists(spans, lambda x: (x["s"] <= start) & (x["e"] >= end))


def char_to_token(offsets: Column, start: Column, end: Column) -> Column:
    """Character span to token span, given the tokens' first characters: the token that holds start, up to the first token at or after end."""
    before = F.size(F.filter(offsets, lambda x: x < start))
    left = F.when(F.array_contains(offsets, start), before).otherwise(F.size(F.filter(offsets, lambda x: x <= start)) - 1)
    return F.struct(left.alias("s"), F.size(F.filter(offsets, lambda x: x < end)).alias("e"))


def length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, x: a + x["e"] - x["s"])
