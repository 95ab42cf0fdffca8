"""Runs of paid calls that can be stopped anywhere and taken up again.

A run's folder belongs to one fingerprint (of protocol, model and code). Within it a call is reserved before it is made and a receipt is
written after it; both are appended under Spark's commit protocol, with the attempt they belong to. Taken up again, a run

* calls no task that has a successful receipt,
* calls no task that was reserved and has no receipt for it: whether it was paid is not known, and it is reported as in doubt,
* calls failed tasks again, within the ceiling of their category.

As a stream, a batch that died between its receipts and its commit is given again, finds its receipts and calls nothing. A task
of Spark's that is retried calls again within its attempt, so clients should pass the key on as their idempotency key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators import spend
from tidewater.sources.clients import Client, answer, echo_client

RESERVATIONS = "key string, category string, amount double, attempt string"
RECEIPTS = "key string, output string, prompt_tokens long, output_tokens long, finish string, error string, cost double, attempt string"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has been appended below ``path`` so far."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bind(spark: SparkSession, folder: str, fingerprint: str) -> None:
    """The folder takes ``fingerprint``, or has it already; another one is refused."""
    path = f"{folder}/fingerprint"
    try:
        spark.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("errorifexists").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    found = spark.read.schema("fingerprint string").json(path).head()
    if found is None or found[0] != fingerprint:
        raise ValueError(f"{folder} belongs to another fingerprint; use a new folder")


@dataclass
class Run:
    """Tasks are (key, prompt, seed, category, amount), where ``amount`` is the most that a call can cost; ceilings go by category."""

    folder: str
    fingerprint: str
    client: Client = echo_client
    ceilings: dict[str, float] = field(default_factory=dict)
    #: Called between a batch's receipts and its end; tests stop a run there.
    after_receipts: Callable[[], None] | None = None

    def reservations(self, spark: SparkSession) -> DataFrame:
        return stored(spark, f"{self.folder}/reservations", RESERVATIONS)

    def receipts(self, spark: SparkSession) -> DataFrame:
        return stored(spark, f"{self.folder}/receipts", RECEIPTS)

    def in_doubt(self, spark: SparkSession) -> DataFrame:
        """``key, attempt`` of reservations without a receipt."""
        return self.reservations(spark).join(self.receipts(spark).select("key", "attempt"), ["key", "attempt"], "left_anti").select("key", "attempt")

    def spent(self, spark: SparkSession) -> DataFrame:
        """``category, spent``: costs of receipts, and reservations in full where there is none."""
        rows = self.reservations(spark).join(self.receipts(spark).select("key", "attempt", "cost"), ["key", "attempt"], "left")
        return rows.groupBy("category").agg(F.sum(F.coalesce("cost", "amount")).alias("spent"))

    def batch(self, tasks: DataFrame, batch_id: int = 0) -> None:
        """Reserve, call and keep what the tasks still lack. A key that repeats is one task."""
        spark = tasks.sparkSession
        bind(spark, self.folder, self.fingerprint)
        done = self.receipts(spark).where("error IS NULL").select("key")
        todo = tasks.dropDuplicates(["key"]).join(done, "key", "left_anti").join(self.in_doubt(spark).select("key"), "key", "left_anti")
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        asked = todo.select("key", "category", F.xxhash64("key").alias("seq"), "amount")
        if self.ceilings:
            left = spark.createDataFrame(list(self.ceilings.items()), "category string, ceiling double").join(self.spent(spark), "category", "left")
            left = left.select("category", (F.col("ceiling") - F.coalesce("spent", F.lit(0.0))).alias("ceiling"))
            granted = spend.within_ceiling(asked, left).where("granted").select("key")
            asked = asked.join(granted, "key", "left_semi")
        asked.select("key", "category", "amount", F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{self.folder}/reservations")
        mine = self.reservations(spark).where(F.col("attempt") == attempt)
        calls = answer(tasks.dropDuplicates(["key"]).join(mine.select("key"), "key", "left_semi"), self.client)
        cost = (F.col("prompt_tokens") * spend.INPUT_RATE + F.col("output_tokens") * spend.OUTPUT_RATE) / 1e6
        receipts = calls.withColumn("cost", F.coalesce(cost, F.lit(0.0))).withColumn("attempt", F.lit(attempt))
        receipts.write.mode("append").parquet(f"{self.folder}/receipts")
        if self.after_receipts:
            self.after_receipts()

    def stream(self, tasks: DataFrame) -> StreamingQuery:
        """The same for a stream of tasks, as far as there are any now; its checkpoint lies in the run's folder."""
        bind(tasks.sparkSession, self.folder, self.fingerprint)
        writer = tasks.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(availableNow=True).start()
