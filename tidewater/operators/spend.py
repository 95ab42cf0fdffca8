"""Money that is spent once: reserved before a call, settled after its receipt is saved, refused beyond a ceiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.prefix import BLOCK_ROWS, fold_before

#: Dollars per million tokens in and out, the output cap of a call, and the margin of a reservation.
INPUT_RATE, OUTPUT_RATE, OUTPUT_CAP, MARGIN = 0.1, 0.4, 1024, 1.01


def reader_reservation(native_tokens: Column) -> Column:
    """The most that a reader's call can cost: its native tokens and a full answer, with a margin."""
    return (native_tokens * INPUT_RATE + OUTPUT_CAP * OUTPUT_RATE) / 1e6 * MARGIN


def judge_reservation(body: Column) -> Column:
    """The same for a judge, whose tokens are not counted: no text has more tokens than bytes."""
    return reader_reservation(F.octet_length(body))


def states(log: DataFrame) -> DataFrame:
    """``key, category, reserved, cost, state, blocked`` from a log (key, seq, category, action, amount).

    The first reservation of a key counts and later ones are refused, as its fate is not known; a settlement without a
    reservation is ignored. A reservation that is not settled blocks its key.
    """
    first = F.min(F.when(F.col("action") == "reserve", F.struct("seq", "category", "amount")))
    settled = F.max(F.when(F.col("action") == "settle", F.struct("seq", "amount")))
    rows = log.groupBy("key").agg(first.alias("r"), settled.alias("s"), F.count_if(F.col("action") == "reserve").alias("tries")).where("r IS NOT NULL")
    cost = F.when(F.col("s.seq") > F.col("r.seq"), F.col("s.amount"))
    rows = rows.select("key", F.col("r.category").alias("category"), F.col("r.amount").alias("reserved"), cost.alias("cost"), (F.col("tries") - 1).alias("refused"))
    return rows.withColumn("state", F.when(F.col("cost").isNull(), "reserved").otherwise("complete")).withColumn("blocked", F.col("cost").isNull())


def within_ceiling(requests: DataFrame, ceilings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Requests (key, category, seq, amount) with ``spent`` before each and whether it is granted: a strict prefix of each category.

    What comes after the first refusal waits too, so the sum is a running one, over blocks of rows; ceilings (category,
    ceiling) are a handful.
    """
    rows = fold_before(requests.select("key", "category", "seq", "amount"), ["category"], ["seq", "key"], "amount", "sum", "spent", block_rows)
    rows = rows.withColumn("spent", F.coalesce("spent", F.lit(0.0))).join(ceilings, "category", "left")
    granted = (F.col("amount") >= 0) & F.coalesce(F.col("spent") + F.col("amount") <= F.col("ceiling"), F.lit(False))
    return rows.select("key", "category", "spent", granted.alias("granted"))
