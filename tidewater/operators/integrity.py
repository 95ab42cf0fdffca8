"""Integrity of stored results: conflicts, repairs, named checks, fingerprints, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicts(rows: DataFrame, keys: list[str], digest: str, failed: Column) -> DataFrame:
    """Keys whose successful rows differ in their digest."""
    return rows.where(~failed).groupBy(*keys).agg(F.countDistinct(digest).alias("digests")).where("digests > 1")


def repaired(rows: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """Rows with repairs (key, repair_of, fingerprint, value) put in. A repair may only replace a failure, must name it and share its fingerprint."""
    fix = repairs.select(key, F.col("repair_of"), F.col("fingerprint").alias("_f"), F.col("value").alias("_v"))
    joined = rows.join(fix, key, "left")
    valid = F.col("failed") & (F.col("repair_of") == F.col(key)) & (F.col("_f") == F.col("fingerprint"))
    fixed = F.coalesce(valid, F.lit(False))
    return joined.select(key, F.when(fixed, F.col("_v")).otherwise(F.col("value")).alias("value"), (F.col("failed") & ~fixed).alias("failed"), (F.col("_v").isNotNull() & ~fixed).alias("refused"))


def check_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``check, passed, failed`` of named conditions, in one pass; a null condition fails."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items())))
    return rows.select(each.alias("x")).select("x.*").groupBy("check").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def one_to_one(rows: DataFrame, key: str, other: str) -> DataFrame:
    """Keys that are used by more than one of the others."""
    return rows.groupBy(key).agg(F.countDistinct(other).alias("uses")).where("uses > 1")


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, status`` of files (path, digest) against a manifest: ok, changed, missing, extra."""
    rows = files.select("path", F.col("digest").alias("have")).join(manifest.select("path", F.col("digest").alias("want")), "path", "full_outer")
    status = F.when(F.col("want").isNull(), "extra").when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("want"), "ok").otherwise("changed")
    return rows.select("path", status.alias("status"))


def require_one(rows: DataFrame, column: str) -> None:
    """An output belongs to one fingerprint; another refuses to go on."""
    if rows.select(column).distinct().limit(2).count() > 1:
        raise ValueError(f"{column} is mixed; refusing to resume")


def publishable(cells: DataFrame, complete: Column) -> bool:
    """Whether every cell is complete, so that a table may be written."""
    return cells.where(~F.coalesce(complete, F.lit(False))).isEmpty()


def rebased_ids(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Foreign chunk ids (example, source, n_ids) with whether they may be taken over: only if the source's text is the example's own."""
    mine = sources.select(F.col("id").alias("example"), F.col("digest").alias("own"))
    theirs = sources.select(F.col("id").alias("source"), F.col("digest").alias("foreign"))
    joined = rows.join(mine, "example", "left").join(theirs, "source", "left")
    return joined.withColumn("accepted", F.coalesce(F.col("own") == F.col("foreign"), F.lit(False))).select(*rows.columns, "accepted")


def require_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows``, if each key is known; an unknown one raises as it is met, and no count is taken first."""
    ids = known.select(key).distinct().withColumn("_known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    checked = F.when(F.col("_known"), F.col(key)).otherwise(unknown.cast(rows.schema[key].dataType))
    return rows.join(ids, key, "left").withColumn(key, checked).select(*rows.columns)
