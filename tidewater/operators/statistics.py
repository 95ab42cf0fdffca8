"""Cell aggregates, intervals and frontiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.layout import written
from tidewater.operators.prefix import BLOCK_ROWS, fold_before


def mean(value: Column, digits: int = 6) -> Column:
    """Mean of what is there; null for nothing."""
    return F.round(F.avg(value), digits)


#: Seeds that a grid may have.
MAX_SEEDS = 100


def seed_mean(rows: DataFrame, seeds: DataFrame, keys: list[str], value: str, seed: str = "seed") -> DataFrame:
    """Mean over a dense grid of seeds; a missing answer counts as zero. The seeds are a handful; more than ``MAX_SEEDS`` are refused."""
    found = [r[0] for r in seeds.select(seed).distinct().limit(MAX_SEEDS + 1).collect()]
    if len(found) > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} seeds")
    kind = rows.schema[seed].dataType
    grid = rows.select(*keys).distinct().withColumn(seed, F.explode(F.array(*map(F.lit, found)).cast(f"array<{kind.simpleString()}>")))
    full = grid.join(rows.select(*keys, seed, value), [*keys, seed], "left")
    return full.groupBy(*keys).agg(F.round(F.avg(F.coalesce(value, F.lit(0.0))), 6).alias("mean"))


def complete_mean(rows: DataFrame, n_seeds: int, keys: list[str], value: str, seed: str = "seed") -> DataFrame:
    """The mean of those keys alone that have every seed."""
    return rows.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.countDistinct(seed).alias("n")).where(F.col("n") == n_seeds).drop("n")


def pareto(rows: DataFrame, x: str, y: str, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows no other of the keys beats: rising x, strictly rising y."""
    best = fold_before(rows, keys, [F.col(x), F.desc(y)], y, "max", "best", block_rows)
    return best.where(F.col("best").isNull() | (F.col(y) > F.col("best"))).drop("best")


def latest(rows: DataFrame, keys: list[str], failed: Column, seq: str) -> DataFrame:
    """One row per key: the latest success, else the latest failure."""
    order = Window.partitionBy(*keys).orderBy(failed.cast("int"), F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: How far the positions of two strata lie apart, so that their draws differ.
STRATUM_STEP = 15_485_863


def portable_draw(replicate: Column, position: Column, n: Column) -> Column:
    """Which cluster a replicate draws at a position: a rule that every engine computes alike."""
    seed = F.pmod(replicate * 7919 + position * 104729 + 12345, F.lit(2147483648))  # first, so that no product leaves 64 bits
    return F.pmod(seed * F.lit(1103515245), F.lit(2147483648)) % n


def portable_bootstrap(clusters: DataFrame, draws: int, keys: list[str]) -> DataFrame:
    """``lo, hi, estimate`` of the ratio of sums over clusters (keys, cluster_sum, cluster_n).

    Draws are rows, so replicates spread over tasks; a join on the cluster's number within its key looks values up.
    """
    order = Window.partitionBy(*keys).orderBy("cluster")
    numbered = clusters.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    picks = numbered.select(*keys, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r")).withColumn("pick", portable_draw(F.col("r").cast("long"), F.col("i").cast("long"), F.col("n")).cast("int"))
    values = numbered.select(*keys, F.col("i").alias("pick"), "cluster_sum", "cluster_n")
    each = picks.join(values, [*keys, "pick"]).groupBy(*keys, "r").agg((F.sum("cluster_sum") / F.sum("cluster_n")).alias("x"))
    ci = each.groupBy(*keys).agg(F.round(F.percentile("x", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("x", F.lit(0.975)), 6).alias("hi"))
    whole = clusters.groupBy(*keys).agg(F.round(F.sum("cluster_sum") / F.sum("cluster_n"), 6).alias("estimate"), F.count("*").alias("n_clusters"))
    return whole.join(ci, keys)


def stratified_bootstrap(clusters: DataFrame, draws: int, keys: list[str], stratum: str = "stratum", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``estimate, lo, hi, n_clusters``: :func:`portable_bootstrap` with clusters drawn within strata of (keys, stratum, cluster).

    A draw is a rule of replicate, position and the stratum's size, so it needs no generator and no stratum in one task: clusters
    are numbered by blocks, and a replicate's sums are added up over the strata as partial sums.
    """
    within = [*keys, stratum]
    rows = fold_before(clusters.withColumn("_one", F.lit(1)), within, ["cluster"], "_one", "sum", "i", block_rows).withColumn("i", F.coalesce("i", F.lit(0)))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy(stratum))  # over a row a stratum
    sizes = clusters.groupBy(*within).agg(F.count("*").alias("n")).withColumn("s", number)
    rows = written(rows.join(sizes, within).select(*within, F.col("i").cast("long").alias("i"), "n", "s", "cluster_sum", "cluster_n"), "numbered")
    picks = rows.select(*within, "i", "n", "s", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"))
    picks = picks.select(*within, "r", portable_draw(F.col("r").cast("long"), F.col("i") + F.col("s") * STRATUM_STEP, F.col("n")).alias("i"))
    sums = [F.sum("cluster_sum").alias("cluster_sum"), F.sum("cluster_n").alias("cluster_n")]
    each = picks.groupBy(*within, "r", "i").agg(F.count("*").alias("times")).join(rows.drop("n", "s"), [*within, "i"])
    each = each.groupBy(*keys, "r").agg((F.sum(F.col("cluster_sum") * F.col("times")) / F.sum(F.col("cluster_n") * F.col("times"))).alias("x"))
    ci = each.groupBy(*keys).agg(F.round(F.percentile("x", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("x", F.lit(0.975)), 6).alias("hi"))
    whole = clusters.groupBy(*keys).agg(*sums, F.count("*").alias("n_clusters")).withColumn("estimate", F.round(F.col("cluster_sum") / F.col("cluster_n"), 6))
    return whole.drop("cluster_sum", "cluster_n").join(ci, keys)


def cluster_bootstrap(clusters: DataFrame, keys: list[str], draws: int = 2000, seed: int = 5768) -> DataFrame:
    """The same with numpy's generator, clusters resampled within strata: one small group of cluster sums per key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stratum", "cluster"])
        rng, total, size = np.random.default_rng(seed), np.zeros(draws), np.zeros(draws)
        strata = [(g.cluster_sum.to_numpy(), g.cluster_n.to_numpy()) for _, g in pdf.groupby("stratum", sort=True)]
        for d in range(draws):
            for sums, n in strata:
                pick = rng.integers(0, len(sums), len(sums))
                total[d] += sums[pick].sum()
                size[d] += n[pick].sum()
        lo, hi = np.quantile(total / size, [0.025, 0.975])
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf.cluster_sum.sum() / pdf.cluster_n.sum(), lo, hi, len(pdf)]], columns=[*keys, "estimate", "lo", "hi", "n_clusters"])

    types = ", ".join(f"{k} {clusters.schema[k].dataType.simpleString()}" for k in keys)
    return clusters.groupBy(*keys).applyInPandas(run, f"{types}, estimate double, lo double, hi double, n_clusters long")


def paired_clusters(left: DataFrame, right: DataFrame) -> DataFrame:
    """``cluster, cluster_sum, cluster_n, complete`` of the differences left minus right on common examples.

    Sides are (example_id, cluster, value, evaluable). A failure (null value) counts as 0; examples that either side can't evaluate
    are left out; a pair whose clusters differ raises.
    """
    b = right.select("example_id", F.col("cluster").alias("cluster_b"), F.col("value").alias("value_b"), F.col("evaluable").alias("evaluable_b"))
    rows = left.join(b, "example_id").where("evaluable AND evaluable_b")
    same = F.when(F.col("cluster").eqNullSafe(F.col("cluster_b")), F.col("cluster")).otherwise(F.raise_error(F.lit("a pair has two clusters")).cast(left.schema["cluster"].dataType))
    rows = rows.withColumn("cluster", same).withColumn("d", F.coalesce("value", F.lit(0.0)) - F.coalesce("value_b", F.lit(0.0)))
    both = F.col("value").isNotNull() & F.col("value_b").isNotNull()
    return rows.groupBy("cluster").agg(F.sum("d").alias("cluster_sum"), F.count("*").alias("cluster_n"), F.count_if(both).alias("complete"))


def paired_interval(left: DataFrame, right: DataFrame, draws: int = 200) -> DataFrame:
    """One row: the ratio of sums over clusters, its interval, and the counts of pairs. Under two clusters there is no interval and it raises."""
    clusters = paired_clusters(left, right)
    few = F.when(F.col("n_clusters") < 2, F.raise_error(F.lit("at least two independent clusters are required")).cast("double")).otherwise(F.col("estimate"))
    one = portable_bootstrap(clusters.withColumn("k", F.lit(0)), draws, ["k"]).withColumn("estimate", few)
    counts = clusters.groupBy(F.lit(0).alias("k")).agg(F.sum("cluster_n").alias("n_paired"), F.sum("complete").alias("n_complete_pairs"))
    sides = left.select("example_id", F.col("evaluable").alias("l")).join(right.select("example_id", F.col("evaluable").alias("r")), "example_id", "full_outer")
    missing = sides.groupBy(F.lit(0).alias("k")).agg(
        F.count_if(F.col("r").isNull()).alias("n_unpaired_left"), F.count_if(F.col("l").isNull()).alias("n_unpaired_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & ~(F.col("l") & F.col("r"))).alias("n_missing_annotations")
    )
    return one.join(counts, "k").join(missing, "k").drop("k")  # a row each


def round_robin(rows: DataFrame, group: str, digest: Column, n: int) -> DataFrame:
    """A stratified sample of n: one of each group in turn, groups by name, within a group by hash."""
    rows = rows.withColumn("turn_no", F.row_number().over(Window.partitionBy(group).orderBy(digest)))
    return rows.where(F.col("turn_no") <= n).orderBy("turn_no", group).limit(n)  # each task gives n rows of a group at most
