"""Token layouts that are made once for a text and used again: where each token ends, by the digest of its source.

A store holds a layout (source_sha256, ends) for each text and tokenizer, bucketed by digest. A text that changes has another digest, so it is laid
out anew and nothing else is; what is stored stays where it is when texts are joined to it. Chunks, spans and budgets are
arithmetic on a layout and need no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.tokens import pieces
from tidewater.operators.chunking import OVERLAP, SIZE

BUCKETS = 64


def token_ends(parts: Column) -> Column:
    """Characters of a text's first 1, 2, ... tokens. Linear: lengths are added up over the characters' own token numbers."""
    lengths = F.transform(parts, lambda x: F.char_length(x))
    # an aggregate that appends would copy its array for each token; sums of blocks are short, and so are the sums within one
    block = 256
    starts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(block))
    within = F.transform(starts, lambda s: F.slice(lengths, s + 1, F.lit(block)))
    running = F.transform(within, lambda b: F.transform(F.sequence(F.lit(1), F.size(b)), lambda n: F.aggregate(F.slice(b, F.lit(1), n), F.lit(0), lambda a, x: a + x)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    placed = F.aggregate(running, empty, lambda acc, b: F.struct((acc["at"] + F.element_at(b, -1)).alias("at"), F.concat(acc["out"], F.array(F.transform(b, lambda x: x + acc["at"]))).alias("out")))
    return F.when(F.size(parts) > 0, F.flatten(placed["out"])).otherwise(F.array().cast("array<int>"))


def open_layouts(spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """The store in ``folder`` as the table ``name``, made if there is none."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (source_sha256 STRING, ends ARRAY<INT>, made STRING) USING parquet CLUSTERED BY (source_sha256) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def with_source(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("source_sha256", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def lay_out(docs: DataFrame, store: str, made: str, text: str = "text", buckets: int = BUCKETS) -> None:
    """Lay out the texts that the store lacks, each once, marked with ``made``."""
    spark = docs.sparkSession
    known = spark.table(store).select("source_sha256").hint("merge")
    missing = with_source(docs.select(text), text).join(known, "source_sha256", "left_anti").groupBy("source_sha256").agg(F.min(text).alias(text))
    rows = missing.select("source_sha256", token_ends(pieces(F.coalesce(text, F.lit("")))).alias("ends"), F.lit(made).alias("made"))
    rows.repartition(buckets, "source_sha256").write.insertInto(store)


def with_layout(docs: DataFrame, store: str, text: str = "text") -> DataFrame:
    """``docs`` with their ``source_sha256``, ``ends`` and ``made``: the store isn't shuffled."""
    return with_source(docs, text).join(docs.sparkSession.table(store).hint("merge"), "source_sha256")


def chunk_spans(ends: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The grid's chunks (chunk_ord, token_start, token_end, char_start, char_end) by arithmetic."""
    step, n = size - overlap, F.size(ends)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")

    def chunk(k: Column) -> Column:
        start, end = k * step, F.least(k * step + size, n)
        begin = F.when(start > 0, F.element_at(ends, F.greatest(start, F.lit(1)))).otherwise(0)
        return F.struct(k.alias("chunk_ord"), start.alias("token_start"), end.alias("token_end"), begin.alias("char_start"), F.element_at(ends, end).alias("char_end"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), chunk)).otherwise(F.array())
