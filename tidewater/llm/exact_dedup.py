"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each pass reads more of a text, for fewer rows: byte lengths of all rows, a prefix hash where the length repeats, the
whole text where length and prefix hash both repeat. Which ones repeat reaches the last scan as a bitmap of at most
``MOST_BITS`` bits, which is broadcast: it lets every repeat pass and few others, and those are told apart afterwards by the
keys themselves. So texts are hashed where they are read, however many keys there are. What is shuffled is keys and counts, never
texts, and counts are combined before the shuffle, so a group that holds a third of all rows costs its keys alone.

Defined cases: a null text counts as empty; an empty table gives an empty result; a null id is smaller than any other;
of rows that repeat both id and text exactly one stays. Other columns of the input are not looked at, so their names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import MAX_BROADCAST_ROWS, ascii_lower, materialise, sized

#: Characters that the second pass reads.
PREFIX_CHARS = 128
#: Bits of the bitmap for a key, of all keys at least and at most (16 MB); bits of a row of it, as Spark's bitmap functions have it.
BITS_A_KEY, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 20, 1 << 27, 4096 * 8


def bit_of(bits: int) -> Column:
    return F.pmod(F.xxhash64("n", "p"), F.lit(bits))


def with_repeats(rows: DataFrame, keys: DataFrame, most_bits: int) -> DataFrame:
    """Adds ``maybe``: true where (n, p) is among the materialised ``keys``, and seldom elsewhere."""
    bits = LEAST_BITS
    while bits < min(BITS_A_KEY * keys.count(), most_bits):
        bits *= 2
    at = F.expr(f"at % {ROW_BITS}")
    bitmap = keys.select(bit_of(bits).alias("at")).groupBy(F.expr(f"at div {ROW_BITS}").alias("slot")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = f"CAST(conv(hex(substring(bits, CAST(at % {ROW_BITS} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    rows = rows.withColumn("at", bit_of(bits)).withColumn("slot", F.expr(f"at div {ROW_BITS}"))
    rows = rows.join(F.broadcast(bitmap), "slot", "left")  # at most MOST_BITS / 8 bytes
    return rows.withColumn("maybe", F.expr(f"coalesce(({byte} & shiftleft(1, CAST(at % 8 AS INT))) != 0, false)")).drop("at", "slot", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix_chars: int = PREFIX_CHARS, max_broadcast: int = MAX_BROADCAST_ROWS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. The id can be of any type that has an order.

    Texts are equal when identical after lower-casing A-Z; of a group the row with the largest id is kept.
    ``text_sha256`` is null for texts whose length and prefix are unique, unless ``digest_all``.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select("doc_id", text.alias("t"))
    length, prefix = F.octet_length("t").alias("n"), F.xxhash64(ascii_lower(F.substring("t", 1, prefix_chars))).alias("p")

    lengths = materialise(base.groupBy(length).count().where("count > 1").select("n"), "lengths")
    narrow = base.select(length, prefix).join(sized(lengths, max_broadcast), "n", "left_semi")
    keys = materialise(narrow.groupBy("n", "p").count().where("count > 1").select("n", "p", F.lit(True).alias("again")), "prefixes")
    rows, full = base.select("doc_id", "t", length, prefix), F.sha2(ascii_lower(F.col("t")).cast("binary"), 256)
    if not digest_all:
        rows, full = with_repeats(rows, keys, most_bits), F.when(F.col("maybe"), full)
    rows = materialise(rows.select("doc_id", "n", "p", full.alias("sha"), F.monotonically_increasing_id().alias("rid")), "hashes")
    rows = rows.join(sized(keys, max_broadcast), ["n", "p"], "left")
    groups = rows.where("again").groupBy("n", "p", "sha").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("size"))
    groups = materialise(groups.where("size > 1").select("n", "p", "sha", "best", "size"), "groups")
    out = rows.join(sized(groups, max_broadcast), ["n", "p", "sha"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        (F.col("sha") if digest_all else F.when(F.col("again"), F.col("sha"))).alias("text_sha256"),
    )
