"""Token and text-unit columns. The piece tokenizer is lossless and the same in Java's and RE2's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A piece is a run of other characters with the white space before it; trailing white space is one of its own.
PIECE = r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$"
LEXEME = "[a-z0-9]+"


def pieces(text: Column) -> Column:
    """Pieces of a text; of a null text none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def count(text: Column) -> Column:
    return F.size(pieces(text))


def decode(parts: Column) -> Column:
    return F.array_join(parts, "")


def lexemes(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, as ranking uses them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LEXEME), F.lit(0))


def head(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), n)


def tail(parts: Column, n: Column) -> Column:
    """The last n pieces; none for n = 0, whatever the source."""
    n = F.least(n, F.size(parts))
    return F.slice(parts, F.size(parts) - n + 1, n)


def clip(text: Column, budget: Column) -> tuple[Column, Column]:
    """Text cut to a budget, and whether it was. The tokenizer is additive, so one cut is enough."""
    parts = pieces(text)
    return decode(head(parts, budget)), F.size(parts) > budget


def piece_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece_ord, char_start, char_end, byte_start, byte_end``: a running sum per text, which one shuffle serves."""
    rows = docs.select(F.col(id_col), F.posexplode(pieces(F.col(text_col))).alias("piece_ord", "piece"))
    rows = rows.select(id_col, "piece_ord", F.char_length("piece").cast("long").alias("chars"), F.octet_length("piece").cast("long").alias("bytes"))
    so_far = Window.partitionBy(id_col).orderBy("piece_ord").rowsBetween(Window.unboundedPreceding, 0)
    chars, size = F.sum("chars").over(so_far), F.sum("bytes").over(so_far)
    return rows.select(id_col, "piece_ord", (chars - F.col("chars")).alias("char_start"), chars.alias("char_end"), (size - F.col("bytes")).alias("byte_start"), size.alias("byte_end"))


#: Tokenizers by name: columns that count a text. Others can be added; every result says which one it used.
TOKENIZERS = {"piece": count, "bytes": lambda text: F.octet_length(text), "chars": lambda text: F.char_length(text), "lexeme": lambda text: F.size(lexemes(text))}
