"""A store of judgments by the digest of their request, so that equal requests are paid once.

The store is bucketed by digest on disk: a lookup shuffles the requests to its buckets, and the store itself stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store; requests are dealt to as many.
BUCKETS = 64

STORE = "request_sha256 STRING, model STRING, verdict STRING, prompt_tokens BIGINT, output_tokens BIGINT, cost DOUBLE"


def request_digest(model: Column, body: Column) -> Column:
    """What identifies a request: its model and its whole body."""
    return F.sha2(F.concat(F.char_length(model).cast("string"), F.lit(":"), model, body).cast("binary"), 256)


def open_store(spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """The store in ``folder`` as the table ``name``, made if there is none. Its columns are :data:`STORE`."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({STORE}) USING parquet CLUSTERED BY (request_sha256) SORTED BY (request_sha256) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def add_judgments(store: str, judgments: DataFrame, buckets: int = BUCKETS) -> None:
    """Append judgments; of those that share a request one is kept, the dearest, as that is what was paid at most."""
    spark = judgments.sparkSession
    columns = spark.table(store).columns
    rest = F.struct(F.col("cost"), *(c for c in columns if c not in ("request_sha256", "cost")))
    once = judgments.groupBy("request_sha256").agg(F.max(rest).alias("r")).select("request_sha256", "r.*").select(columns)
    once.repartition(buckets, "request_sha256").write.insertInto(store)


def look_up(requests: DataFrame, store: str) -> DataFrame:
    """Requests (request_sha256, model, ...) with their judgment and its ``status``.

    ``hit``; ``stale_model``: it is of another model; ``missing_usage``: what it used was not kept, so it can't be billed; ``miss``.
    Only hits may be used; the others are told apart for whoever mends the store.
    """
    kept = requests.sparkSession.table(store)
    kept = kept.select("request_sha256", F.col("model").alias("judged_by"), "verdict", "prompt_tokens", "output_tokens", "cost")
    joined = requests.join(kept.hint("merge"), "request_sha256", "left")
    usage = F.col("prompt_tokens").isNull() | F.col("output_tokens").isNull()
    status = F.when(F.col("judged_by").isNull(), "miss").when(F.col("judged_by") != F.col("model"), "stale_model").when(usage, "missing_usage").otherwise("hit")
    return joined.withColumn("status", status)


def to_call(found: DataFrame) -> DataFrame:
    """Each request that has no judgment, once, whatever the number of answers that ask for it."""
    return found.where("status = 'miss'").dropDuplicates(["request_sha256"])
