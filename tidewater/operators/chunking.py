"""Overlapping windows of a fixed grid over a text's pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.tokens import decode, pieces

SIZE, OVERLAP = 64, 16


def chunk_array(parts: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Of a text's pieces, which should not be empty, the array of its windows; the last one ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under size")
    step, n = size - overlap, F.size(parts)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")

    def window(k: Column) -> Column:
        start, end = k * step, F.least(k * step + size, n)
        return F.struct(k.alias("chunk_ord"), start.alias("token_start"), end.alias("token_end"), decode(F.slice(parts, start + 1, end - start)).alias("chunk_text"))

    return F.transform(F.sequence(F.lit(0), last), window)


def chunk_grid(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_ord, token_start, token_end, chunk_text``: no shuffle; an empty text has no chunk."""
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col), pieces(F.col(text_col)).alias("p"))
    return rows.select(id_col, F.inline(chunk_array(F.col("p"), size, overlap)))


def chunk_ids(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return chunk_grid(docs, size, overlap).withColumn("chunk_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_ord").cast("string")))
