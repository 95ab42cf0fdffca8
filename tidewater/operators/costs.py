"""Prices and costs. What has no known price is null, never zero; an unknown machine type costs zero."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_PRICES = "model string, input_rate double, output_rate double, long_threshold long, input_rate_long double, output_rate_long double, thinking_rate double"


def read_prices(path: str) -> tuple[list[tuple], dict[str, float]]:
    """Rows of ``MODEL_PRICES`` and the hourly rates of machines, from a versioned price file (JSON, dollars per million tokens)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    names = ("input_per_1m", "output_per_1m", "long_context_threshold", "input_per_1m_long", "output_per_1m_long", "thinking_per_1m")
    return [(model, *(None if n not in row else int(row[n]) if n == "long_context_threshold" else float(row[n]) for n in names)) for model, row in data["models"].items()], data["gpu_hourly"]


def model_prices(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MODEL_PRICES)


def api_cost(calls: DataFrame, prices: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``cost`` in dollars to calls (model, input_tokens, output_tokens, thought_tokens).

    Past its threshold all of a call is at the long rate. Thoughts cost the thinking rate, and where none is stated that of output. A
    model without a price costs null, or with ``strict`` raises. Prices are a file's rows; Spark picks the join by their size.
    """
    rows = calls.join(prices.withColumn("priced", F.lit(True)), "model", "left")
    long = F.coalesce(F.col("input_tokens") > F.col("long_threshold"), F.lit(False))
    rate = lambda k: F.when(long, F.col(f"{k}_rate_long")).otherwise(F.col(f"{k}_rate"))
    thinking = F.coalesce("thinking_rate", rate("output"))
    cost = F.round((F.col("input_tokens") * rate("input") + F.col("output_tokens") * rate("output") + F.coalesce("thought_tokens", F.lit(0)) * thinking) / 1e6, 8)
    if strict:
        cost = F.when(F.col("priced"), cost).otherwise(F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double"))
    return rows.select(*calls.columns, cost.alias("cost"))


def gpu_cost(kind: Column, seconds: Column, hourly: dict[str, float]) -> Column:
    rate = F.create_map(*(F.lit(x) for pair in hourly.items() for x in pair))
    return F.coalesce(F.try_element_at(rate, kind), F.lit(0.0)) * seconds / 3600


def serving_cost(reader: Column, seconds: Column, hourly: Column) -> Column:
    """Reader's dollars and the selector's share of a machine; null if either is unknown."""
    return F.round(reader + seconds * hourly / 3600, 8)


def selection_cost(reported: Column, device: Column, method: Column, tiered: Column, api: Column, gpu: Column) -> Column:
    """The first rule that applies: reported, CPU unknown, CPU methods unknown, tiered prices unknown, API price, GPU price."""
    cpu = method.isin("head", "tail", "head_tail", "full_context", "bm25")
    return F.when(reported.isNotNull(), reported).when((F.coalesce(device, F.lit("")) == "cpu") | cpu | F.coalesce(tiered, F.lit(False)), F.lit(None).cast("double")).otherwise(F.coalesce(api, gpu))


def usage_cost(prompt: Column, output: Column, batch: Column) -> Column:
    return (prompt * 0.1 + output * 0.4) / 1e6 * F.when(batch, 0.5).otherwise(1.0)


def compression(selected: Column, source: Column) -> Column:
    return selected / F.nullif(source, F.lit(0))


def unused(budget: Column, selected: Column) -> Column:
    """Unused budget, at least 0; null without a budget."""
    return F.when(budget.isNotNull(), F.greatest(budget - selected, F.lit(0)))


def budget_from_label(label: Column) -> Column:
    return F.when(~F.lower(label).isin("inf", "none", "full"), label.try_cast("int"))


def budget_label(budget: Column) -> Column:
    return F.when(budget.isNull(), F.lit("inf")).when(budget % 1000 == 0, F.concat((budget / 1000).cast("int").cast("string"), F.lit("K"))).otherwise(budget.cast("string"))
