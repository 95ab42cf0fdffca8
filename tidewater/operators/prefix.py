"""Folds over the earlier rows of a key, where a key may hold a third of all rows.

Rows are sorted over all tasks by key and order, so a key's rows lie in as many blocks as they fill. A fold runs within a block
and takes up the fold of the key's earlier blocks, of which there is a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.layout import written

#: Rows of a block.
BLOCK_ROWS = 1 << 18

FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def fold_before(rows: DataFrame, keys: list[str], order: list[str | Column], value: str | Column, fold: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``name``: the sum, maximum or minimum of ``value`` over the rows of the same keys that come before; null for the first.

    Equal rows must be interchangeable, or ``order`` tell them apart. Null keys are a key.
    """
    columns = rows.columns
    rows = rows.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id())
    dealt = written(dealt, "blocks")
    take = FOLDS[fold]
    sums = dealt.groupBy(*keys, "_block").agg(take("_value").alias("_all"))
    carried = take("_all").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carries = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), carried.alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    here = take("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = dealt.withColumn("_here", here).join(carries, [F.col("_block") == F.col("_b"), *same])
    if fold == "sum":
        both = F.when(F.col("_here").isNull(), F.col("_carried")).otherwise(F.col("_here") + F.coalesce("_carried", F.lit(0)))
    else:
        both = (F.greatest if fold == "max" else F.least)("_here", "_carried")
    return joined.select(*columns, both.alias(name))
