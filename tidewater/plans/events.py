"""Queries over event streams, retries and the spending ledger. A request is a user's day; its events carry parts of a response."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.layout import fresh_folder
from tidewater.plans.registry import query, table
from tidewater.streaming import events as E

PARTS = """base AS (
  SELECT *, user_id * 100 + day(ts) AS request_id, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id, day(ts)) AS n FROM events
), parts AS (
  SELECT request_id, seq, ts, CASE WHEN event_type <> 'error' THEN event_type || seq END AS text, event_type = 'search' AS thought,
         CASE WHEN seq >= n - 1 AND user_id % 5 <> 0 THEN 'STOP' END AS finish, CASE WHEN seq = 1 OR seq = n THEN seq * 10 END AS prompt,
         CASE WHEN seq = n AND user_id % 4 <> 0 THEN seq * 3 END AS output, CASE WHEN seq >= n - 1 THEN seq * 13 END AS total, 1 AS candidates FROM base
)"""


def parts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("request_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    w = Window.partitionBy("request_id")
    rows = rows.withColumn("seq", F.row_number().over(w.orderBy("ts", "event_id")).cast("long")).withColumn("n", F.count("*").over(w))
    seq, n = F.col("seq"), F.col("n")
    return rows.select(
        "request_id", "seq", "ts", F.when(F.col("event_type") != "error", F.concat("event_type", seq.cast("string"))).alias("text"), (F.col("event_type") == "search").alias("thought"),
        F.when((seq >= n - 1) & (F.col("user_id") % 5 != 0), "STOP").alias("finish"), F.when((seq == 1) | (seq == n), seq * 10).alias("prompt"),
        F.when((seq == n) & (F.col("user_id") % 4 != 0), seq * 3).alias("output"), F.when(seq >= n - 1, seq * 13).alias("total"), F.lit(1).alias("candidates"),
    )


FOLDED = PARTS + """, folded AS (
  SELECT request_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE text IS NOT NULL AND NOT thought), '') AS text, arg_max(finish, seq) FILTER (WHERE finish IS NOT NULL) AS finish,
         arg_max(prompt, seq) FILTER (WHERE prompt IS NOT NULL) AS prompt, arg_max(output, seq) FILTER (WHERE output IS NOT NULL) AS output,
         arg_max(total, seq) FILTER (WHERE total IS NOT NULL) AS total, count(*) AS n_events, max(seq) AS last, min(ts) AS began, max(ts) AS ended,
         min(ts) FILTER (WHERE text IS NOT NULL AND NOT thought) AS first_text FROM parts GROUP BY request_id
), gated AS (
  SELECT f.*, NOT (f.finish IS NULL OR f.prompt IS NULL OR f.total IS NULL OR (f.text <> '' AND f.output IS NULL)) AS complete,
         p.prompt IS NULL OR p.total IS NULL OR p.finish IS NULL AS tail_lacks FROM folded f JOIN parts p ON p.request_id = f.request_id AND p.seq = f.last
)"""


@query("event_fold", f"WITH {FOLDED} SELECT request_id, sha256(text) AS text_sha256, finish, prompt, output, total, n_events, complete, complete AND tail_lacks AS recovered FROM gated")
def event_fold(spark, sf_dir):
    rows = E.fold(parts(spark, sf_dir))
    return rows.select("request_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "finish", "prompt", "output", "total", "n_events", "complete", "recovered")


@query(
    "event_ttft",
    f"WITH {FOLDED} SELECT request_id, CAST(epoch_us(first_text) - epoch_us(began) AS BIGINT) AS ttft_us, CAST(epoch_us(ended) - epoch_us(began) AS BIGINT) AS latency_us, n_events FROM gated",
)
def event_ttft(spark, sf_dir):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return E.fold(parts(spark, sf_dir)).select("request_id", (micros("first_text") - micros("began")).alias("ttft_us"), (micros("ended") - micros("began")).alias("latency_us"), "n_events")


@query("event_fold_streaming", f"WITH {FOLDED} SELECT request_id, text, finish, prompt, output, total, n_events FROM folded")
def event_fold_streaming(spark, sf_dir):
    """The fold as a stateful stream over a written copy of the parts, run until what is there is done.

    An event without a request ends the copy, ten days after the others, so that the watermark passes them all.
    """
    base = fresh_folder(spark, "stream")
    rows = parts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    end = rows.agg(F.max("ts").alias("ts")).select(*(F.expr("ts + INTERVAL 10 DAYS").alias("ts") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    rows.unionByName(end).write.parquet(f"{base}/parts")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/parts")
    out = E.fold_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(E.OUTPUT).parquet(f"{base}/out").where("request_id IS NOT NULL")


@query(
    "event_windows",
    """SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS day_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def event_windows(spark, sf_dir):
    rows = E.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return rows.select("event_type", F.unix_micros("window.start").alias("day_us"), "n", F.round("total", 4).alias("total"))


LEDGER = """ledger AS (SELECT event_id AS key, event_type AS category, value AS reserved, CASE WHEN event_id % 7 <> 0 THEN value * 0.5 END AS cost, CASE WHEN event_id % 7 = 0 THEN 'reserved' ELSE 'settled' END AS state FROM events)"""


def ledger(spark, sf_dir):
    open_ = F.col("event_id") % 7 == 0
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("category"), F.col("value").alias("reserved"), F.when(~open_, F.col("value") * 0.5).alias("cost"), F.when(open_, "reserved").otherwise("settled").alias("state"))


@query("ledger_totals", f"WITH {LEDGER} SELECT category, round(sum(coalesce(cost, reserved)), 4) AS total FROM ledger GROUP BY category")
def ledger_totals(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("category").agg(F.round(F.sum(F.coalesce("cost", "reserved")), 4).alias("total"))


@query(
    "ledger_audit",
    f"""WITH {LEDGER}, receipts AS (SELECT event_id AS key FROM events WHERE event_id % 11 <> 0)
    SELECT category, count(*) FILTER (WHERE state = 'reserved' AND r.key IS NULL) AS unresolved, count(*) FILTER (WHERE state = 'settled' AND r.key IS NULL) AS settled_without_receipt, count(*) FILTER (WHERE cost > reserved) AS over FROM ledger l LEFT JOIN receipts r USING (key) GROUP BY category""",
)
def ledger_audit(spark, sf_dir):
    """Reserve before a call, settle after its receipt is saved: what the two tables say of each category."""
    receipts = table(spark, sf_dir, "events").where("event_id % 11 <> 0").select(F.col("event_id").alias("key"), F.lit(True).alias("got"))
    rows = ledger(spark, sf_dir).join(receipts, "key", "left")
    none = F.col("got").isNull()
    return rows.groupBy("category").agg(F.count_if((F.col("state") == "reserved") & none).alias("unresolved"), F.count_if((F.col("state") == "settled") & none).alias("settled_without_receipt"), F.count_if(F.col("cost") > F.col("reserved")).alias("over"))


@query(
    "retry_backoff",
    """WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, (['HTTP 429', 'HTTP 503', 'read timeout', 'HTTP 400', 'connection reset'])[1 + event_id % 5] AS e FROM events)
    SELECT e AS error, e <> 'HTTP 400' AS transient, count(*) AS n, round(sum(least(15 * pow(2.0, least(k, 8)), 120)), 2) AS waited FROM x GROUP BY e""",
)
def retry_backoff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    error = F.get(F.array(*map(F.lit, ("HTTP 429", "HTTP 503", "read timeout", "HTTP 400", "connection reset"))), (F.col("event_id") % 5).cast("int"))
    return rows.groupBy(error.alias("error"), E.transient(error).alias("transient")).agg(F.count("*").alias("n"), F.round(F.sum(E.backoff(F.least("k", F.lit(8)))), 2).alias("waited"))


@query(
    "response_projection",
    """SELECT event_id, coalesce(trim(json_extract_string(props, '$.page')), '') AS page, json_extract_string(props, '$.ref') AS ref FROM events""",
)
def response_projection(spark, sf_dir):
    """Fields of nested JSON responses."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.trim(F.get_json_object("props", "$.page")), F.lit("")).alias("page"), F.get_json_object("props", "$.ref").alias("ref"))
