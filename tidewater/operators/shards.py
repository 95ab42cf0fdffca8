"""Whether shards share no row and leave none out, by bitmaps of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a bitmap: fixed by Spark's functions.
BITS = 32768


def bitmaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, bucket, bits``: a bitmap of 4 KB of each stretch of ``BITS`` numbers (from 0) that a key has."""
    at = F.col(number) + 1  # Spark's buckets count from 1
    return rows.groupBy(*keys, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def shard_coverage(shards: DataFrame, expected: DataFrame, shard: str, number: str) -> DataFrame:
    """``bucket, expected, covered, overlaps, gaps, strays`` of rows (shard, number) against expected numbers.

    ``overlaps`` counts numbers that more than one shard has, as often as they are too many; ``gaps`` are expected numbers of no shard, and
    ``strays`` those of a shard that were not expected. Rows become a bitmap of each shard and stretch in their tasks, so a shard may be of any size.
    """
    each = bitmaps(shards, [shard], number).groupBy("bucket").agg(F.sum(F.bitmap_count("bits")).alias("held"), F.bitmap_or_agg("bits").alias("any"))
    wanted = bitmaps(expected, [], number).withColumnRenamed("bits", "wanted")
    none = F.expr(f"CAST(repeat(chr(0), {BITS // 8}) AS BINARY)")
    rows = wanted.join(each, "bucket", "full_outer").select("bucket", F.coalesce("wanted", none).alias("wanted"), F.coalesce("any", none).alias("any"), F.coalesce("held", F.lit(0)).alias("held"))
    both = rows.select("bucket", "held", F.bitmap_count("wanted").alias("expected"), F.bitmap_count("any").alias("covered"), F.explode(F.array("wanted", "any")).alias("bits"))
    rows = both.groupBy("bucket", "held", "expected", "covered").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("union"))
    return rows.select("bucket", "expected", "covered", (F.col("held") - F.col("covered")).alias("overlaps"), (F.col("union") - F.col("covered")).alias("gaps"), (F.col("union") - F.col("expected")).alias("strays"))


def multiset_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, n, digest``: a digest of each cell's rows that no order, partitioning or retry changes.

    A row's hash is the first 60 bits of a digest of its columns, told apart from null and from each other by their lengths; hashes
    are added up exactly, so equal cells have equal digests, and rows that repeat count as often as they do.
    """
    told = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(c).cast("string") for c in columns)]
    part = F.conv(F.substring(F.md5(F.concat(*told).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest"))


def reruns_agree(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, n_first, n_second, same`` of two runs, a row a cell; a cell that one run lacks is not the same."""
    a = multiset_digest(first, keys, columns).withColumnsRenamed({"n": "n_first", "digest": "d"})
    b = multiset_digest(second, keys, columns).withColumnsRenamed({"n": "n_second", "digest": "e"})
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_second", F.lit(0)).alias("n_second"), F.col("d").eqNullSafe(F.col("e")).alias("same"))
