"""What a stored selection must hold to be read and scored: renderings, spans, budgets, windows, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import spans, tokens


def renderings(chunks: Column) -> tuple[Column, Column]:
    """Of chunks (rank, chunk_ord, chunk_text) their texts in rank order and in source order, joined by a newline."""
    text = lambda order: F.array_join(F.transform(F.sort_array(F.transform(chunks, lambda c: F.struct(c[order].alias("o"), c["chunk_text"]))), lambda c: c["chunk_text"]), "\n")
    return text("rank"), text("chunk_ord")


def claim_status(text: Column, chunks: Column) -> Column:
    """Whether a text is one of two renderings of the chunks that it claims: ok, mismatch, or repeated (a chunk is claimed twice)."""
    ords = F.transform(chunks, lambda c: c["chunk_ord"])
    rank, source = renderings(chunks)
    return F.when(F.size(F.array_distinct(ords)) < F.size(ords), "repeated").when((text == rank) | (text == source), "ok").otherwise("mismatch")


def render_spans(parts: Column, merged: Column) -> Column:
    """Text of spans of pieces, joined by a newline."""
    return F.array_join(F.transform(merged, lambda x: tokens.decode(F.slice(parts, x["s"] + 1, x["e"] - x["s"]))), "\n")


def union_status(parts: Column, text: Column, claimed: Column) -> Column:
    """Whether a text is the rendering of its spans (text), and these are merged and in order (spans): ok if both are."""
    return F.when(render_spans(parts, claimed) != text, "text").when(spans.merge_array(claimed) != claimed, "spans").otherwise("ok")


def safely_clipped(parts: Column, ids: Column, budget: Column) -> tuple[Column, Column, Column]:
    """Text cut to its budget once more, whether it was, and its chunk ids: none if it was, as it no longer holds whole chunks."""
    over = F.coalesce(F.size(parts) > budget, F.lit(False))
    text = F.when(over, tokens.decode(tokens.head(parts, budget))).otherwise(tokens.decode(parts))
    return text, over, F.when(over, F.filter(ids, lambda x: F.lit(False))).otherwise(ids)


def turn_span(offsets: Column, start: Column, end: Column) -> Column:
    """Character span to token span as for turns: from the token that holds the first character to that of the last one, included."""
    at = lambda c: F.greatest(F.size(F.filter(offsets, lambda x: x <= c)) - 1, F.lit(0))
    first = at(start)
    return F.struct(first.alias("s"), (F.greatest(at(F.greatest(end - 1, start)), first) + 1).alias("e"))


def turn_span_of_pieces(parts: Column, start: Column, end: Column) -> Column:
    """:func:`turn_span` from a text's pieces themselves: one walk over them, whatever their number."""
    last = F.greatest(end - 1, start)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    walked = F.aggregate(parts, zero, lambda acc, x: F.struct((acc["at"] + F.char_length(x)).alias("at"), (acc["s"] + (acc["at"] <= start).cast("int")).alias("s"), (acc["e"] + (acc["at"] <= last).cast("int")).alias("e")))
    first = F.greatest(walked["s"] - 1, F.lit(0))
    return F.struct(first.alias("s"), (F.greatest(walked["e"] - 1, first) + 1).alias("e"))


def spans_of_ids(ids: Column, size: int, overlap: int) -> Column:
    """Merged spans of chunk ids like ``7::3`` by arithmetic alone; malformed ids are skipped."""
    number = F.transform(ids, lambda x: F.regexp_extract(x, r"::\s*([+-]?\d+)\s*$", 1).try_cast("int"))
    step = size - overlap
    return spans.merge_array(F.transform(F.filter(number, lambda n: n.isNotNull()), lambda n: F.struct((n * step).alias("s"), (n * step + size).alias("e"))))


def require_count(rows: DataFrame, expected: int | None) -> DataFrame:
    """``rows``, if they are as many as expected; None expects nothing."""
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return rows


def window_guard(native_tokens: Column, output_cap: Column, window: int = 1_048_576) -> Column:
    """Whether a call fits a reader's context window, its answer included."""
    return native_tokens + output_cap <= window
