"""Tokens, time and cost of runs and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.operators.order_stats import quantiles


def _total(df: DataFrame, names: tuple[str, ...]) -> Column:
    """Sum over the columns that are present; NULL if no row has any."""
    present = [F.col(name) for name in names if name in df.columns]
    if not present:
        return F.lit(None).cast("bigint")
    some = present[0].isNotNull()
    row = F.coalesce(present[0], F.lit(0))
    for column in present[1:]:
        some, row = some | column.isNotNull(), row + F.coalesce(column, F.lit(0))
    return F.sum(F.when(some, row))


def run_cost(predictions: DataFrame, run: str, input_tokens: tuple[str, ...], output_tokens: tuple[str, ...]) -> DataFrame:
    """Per run: items, tokens under any of the given names, cost (NULL where none is recorded), and request times."""
    sums = predictions.groupBy(run).agg(
        F.count("*").alias("items"),
        _total(predictions, input_tokens).alias("input_tokens"),
        _total(predictions, output_tokens).alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count("seconds").alias("requests_timed"),
    )
    times = quantiles(predictions, [run], "seconds", {"median_seconds": 0.5})
    return sums.join(times, run, "left").withColumn("cost_per_item_usd", F.col("cost_usd") / F.col("items"))


def condition_usage(requests: DataFrame, records: DataFrame, batches: DataFrame, open_ids: DataFrame, conditions: DataFrame, prices: DataFrame) -> DataFrame:
    """Per condition: units, answered units, answers from batches, requests in open batches, mean tokens and seconds,
    and the cost of direct requests and of batches.

    ``requests``: condition, request_id; ``records``: one saved answer per request_id; ``batches``: condition and cost of
    each collected batch; ``prices``: provider, model, input and output price per million tokens. A direct request costs
    what its provider reports, nothing for a local model, or its tokens at the listed price."""
    joined = requests.join(records, "request_id", "left").join(open_ids.select("request_id", F.lit(1).alias("_open")), "request_id", "left")
    direct = F.col("batch_id").isNull() & F.col("prompt_tokens").isNotNull()
    sums = joined.groupBy("condition").agg(
        F.count("*").alias("units"),
        F.count("prompt_tokens").alias("answered_units"),
        F.count("batch_id").alias("answered_in_batches"),
        F.count("_open").alias("in_open_batches"),
        F.sum(F.when(direct, F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0)).alias("_reported"),
        F.sum(F.when(direct, F.col("prompt_tokens")).otherwise(0)).alias("_in"),
        F.sum(F.when(direct, F.col("completion_tokens")).otherwise(0)).alias("_out"),
        *[F.avg(name).alias(f"mean_{name}") for name in ("prompt_tokens", "completion_tokens", "seconds")],
    )
    by_batch = batches.groupBy("condition").agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("batch_cost_usd"))
    table = conditions.join(sums, "condition").join(by_batch, "condition", "left").join(prices, ["provider", "model"], "left")
    priced = (F.col("_in") * F.col("input_price") + F.col("_out") * F.col("output_price")) / 1e6
    cost = F.when(F.col("reports_cost"), F.col("_reported")).when(F.col("local"), F.lit(0.0)).otherwise(priced)
    return table.withColumns({"direct_cost_usd": cost, "batch_cost_usd": F.coalesce("batch_cost_usd", F.lit(0.0))}).drop("_reported", "_in", "_out")
