"""The ledger of requests: what is pending, how it is batched, and what became of submissions and results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.operators.order_stats import unique_index
from thetaloom.session import written

# Statuses in which a batch has ended, and how much older than its submission a batch may look.
TERMINAL = ["completed", "failed", "expired", "cancelled"]
CLOCK_TOLERANCE_SECONDS = 60
CHUNK = 100_000


def shuffled_order(key, seed: int = 0) -> Column:
    """A fixed pseudo-random order, so that a capped run samples every group."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def pending(requests: DataFrame, saved: DataFrame, open_ids: DataFrame, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Requests without a saved output that are in no open batch, at most ``cap`` of them in the fixed order."""
    rest = requests.join(saved.select("request_id"), "request_id", "left_anti").join(open_ids.select("request_id"), "request_id", "left_anti")
    return rest if cap is None else rest.orderBy(shuffled_order("request_id", seed), "request_id").limit(cap)


def work_status(requests: DataFrame, saved: DataFrame, open_ids: DataFrame, saved_items: DataFrame) -> DataFrame:
    """Each request as saved, in a submitted batch, saved for other inputs or settings, or not predicted yet."""

    def marked(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(1))

    joined = (
        requests.join(marked(saved, "request_id", "_saved"), "request_id", "left")
        .join(marked(open_ids, "request_id", "_open"), "request_id", "left")
        .join(marked(saved_items, "item_key", "_other"), "item_key", "left")
    )
    status = (
        F.when(F.col("_saved") == 1, "saved").when(F.col("_open") == 1, "in a submitted batch")
        .when(F.col("_other") == 1, "saved for other inputs or settings").otherwise("not predicted yet")
    )
    return joined.withColumn("status", status).drop("_saved", "_open", "_other")


def recheck(stored: DataFrame, reason: Column) -> DataFrame:
    """Stored outputs that fail today's checks, with the reason; they are pending again."""
    return stored.withColumn("reason", reason).filter("reason is not null")


def row_index(df: DataFrame, groups: list[str], order: str, out: str) -> DataFrame:
    """The 0-based place of each row in its group by a unique column of any type, whatever the size of the group."""
    return unique_index(df, groups, order, order, out)


def chunked(requests: DataFrame, schema: str, order: str, size: int) -> DataFrame:
    """Requests in batches of at most ``size`` of one output schema."""
    return row_index(requests, [schema], order, "_i").withColumn("chunk", F.floor(F.col("_i") / size)).drop("_i")


def next_fit(units: DataFrame, key: str, order: str, size: str, capacity: int, chunk: int = CHUNK) -> DataFrame:
    """``units`` with their ``batch`` per key: in order, a unit joins the open batch if it fits, else it opens one.

    Whether a batch has room is a state from 0 to ``capacity``, so a stretch of consecutive units is a map from the
    state before it to the state and the number of batches after it. Stretches of bounded length give their maps in
    parallel, a pass over the maps gives the state before each, and then the stretches number their batches in parallel.
    """
    table = written(row_index(units, [key], order, "_i").withColumn("_chunk", F.floor(F.col("_i") / chunk).cast("bigint")), "units")
    key_type = table.schema[key].dataType.simpleString()
    columns = table.columns

    def step(fill, n: int):
        fits = fill + n <= capacity
        return np.where(fits, fill + n, min(n, capacity)), np.logical_not(fits)

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        fill, opened = np.arange(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
        for n in frame.sort_values("_i")[size].to_numpy():
            fill, new = step(fill, int(n))
            opened += new
        return pd.DataFrame({key: [frame[key].iloc[0]], "_chunk": [frame["_chunk"].iloc[0]], "_fill": [fill.tolist()], "_opened": [opened.tolist()]})

    maps = table.groupBy(key, "_chunk").applyInPandas(summary, f"{key} {key_type}, _chunk bigint, _fill array<bigint>, _opened array<bigint>")

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        rows, fill, batches = [], capacity, 0
        for chunk_, fills, opened in frame.sort_values("_chunk")[["_chunk", "_fill", "_opened"]].itertuples(index=False):
            rows.append((frame[key].iloc[0], chunk_, fill, batches))
            fill, batches = int(fills[fill]), batches + int(opened[fill])
        return pd.DataFrame(rows, columns=[key, "_chunk", "_before", "_batches"])

    starts = maps.groupBy(key).applyInPandas(scan, f"{key} {key_type}, _chunk bigint, _before bigint, _batches bigint")

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_i")
        fill, batch, result = int(frame["_before"].iloc[0]), int(frame["_batches"].iloc[0]) - 1, []
        for n in frame[size].tolist():
            if fill + n <= capacity:
                fill += n
            else:
                fill, batch = min(n, capacity), batch + 1
            result.append(batch)
        return frame.assign(batch=result)[[*columns, "batch"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    joined = table.join(starts, [key, "_chunk"])
    return joined.groupBy(key, "_chunk").applyInPandas(number, f"{fields}, batch bigint").drop("_i", "_chunk")


def open_request_ids(batches: DataFrame) -> DataFrame:
    """Request IDs of submitted batches that are not collected yet, from a row per batch and request: however many requests
    a batch has, they never meet in one row."""
    return batches.filter("collected_at is null").select("batch_id", "request_id")


def first_results(results: DataFrame, order: str) -> DataFrame:
    """The first result of each request: a request is saved once."""
    rest = [name for name in results.columns if name != "request_id"]
    picked = results.groupBy("request_id").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select("request_id", "_r.*")


def collected(submitted: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """The outcome of every submitted request of a batch that has ended.

    ``submitted``: request_id, batch_id, batch_status; ``requests``: today's request_ids; ``results``: at most one per
    request with status_code, error and unusable."""
    current = requests.select("request_id", F.lit(1).alias("_current"))
    joined = submitted.filter(F.col("batch_status").isin(TERMINAL)).join(current, "request_id", "left").join(results, "request_id", "left")
    outcome = (
        F.when(F.col("_current").isNull(), "not saved: the request has changed since it was submitted")
        .when(F.col("status_code").isNull() & F.col("error").isNull(), F.concat(F.lit("no result: the batch "), "batch_status"))
        .when(F.col("error").isNotNull() | (F.col("status_code") != 200), "failed")
        .when(F.col("unusable").isNotNull(), "unusable")
        .otherwise("saved")
    )
    return joined.withColumn("outcome", outcome).drop("_current")


def run_names(conditions: DataFrame, run: str, position: str, scorer: str) -> DataFrame:
    """The name of each run from its conditions (provider, model, effort and role as they show in names): its model with the
    efforts, or for several models their number and a hash of their settings; its roles; and the ``scorer``. Efforts and
    roles stand in the order of ``position``, each once. A run has a few conditions."""
    first = lambda column: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(position, F.col(column).alias("x")))), lambda e: e["x"]))
    named = conditions.withColumns({"_llm": F.concat_ws("-", "provider", "model"), "_settings": F.concat_ws("-", "provider", "model", "effort")})
    sums = named.groupBy(run).agg(
        F.count_distinct("_llm").alias("n"), F.min("_llm").alias("llm"), first("effort").alias("efforts"), first("role").alias("roles"),
        F.sort_array(F.collect_set("_settings")).alias("settings"),
    )
    one = F.concat_ws("-", "llm", F.array_join("efforts", "+"))
    several = F.concat_ws("-", F.col("n").cast("string"), F.lit("models"), F.left(F.sha2(F.array_join("settings", "|"), 256), F.lit(8)))
    name = F.concat_ws("__", F.when(F.col("n") == 1, one).otherwise(several), F.array_join("roles", "+"), F.lit(f"scorer-{scorer}"))
    return sums.select(run, name.alias("run_name"))


def run_report(outcomes: DataFrame, run: str, submitted: DataFrame, requests: DataFrame) -> DataFrame:
    """Per run: collected requests as saved, failed, unusable or changed, their cost, and saved outputs without a reported cost;
    ``in_batches``, submitted requests whose batch is still open; and ``missing``, today's requests that have no saved output
    and are in no open batch, which a next run sends. A run that shows in any of the tables has a row."""
    is_ = lambda text: F.col("outcome").startswith(text)
    count = lambda test: F.sum(test.cast("bigint"))
    still_open = submitted.filter(~F.col("batch_status").isin(TERMINAL))
    rest = pending(requests, outcomes.filter(is_("saved")), still_open)
    waiting = still_open.select(run, F.lit("in a batch").alias("outcome")).unionAll(rest.select(run, F.lit("missing").alias("outcome")))
    rows = outcomes.select(run, "outcome", "cost_usd").unionByName(waiting, allowMissingColumns=True)
    return rows.groupBy(run).agg(
        count(~F.col("outcome").isin("in a batch", "missing")).alias("requested"), count(is_("saved")).alias("saved"),
        count(is_("failed") | is_("no result")).alias("failed"), count(is_("unusable")).alias("unusable"), count(is_("not saved")).alias("changed"),
        count(is_("in a batch")).alias("in_batches"), count(is_("missing")).alias("missing"), F.sum("cost_usd").alias("cost_usd"),
        count(is_("saved") & F.col("cost_usd").isNull()).alias("uncosted"),
    )


def reconcile(unconfirmed: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """What to do with submissions (submission_id, model, n_requests, submitted_at) that were not confirmed: adopt the one
    batch (batch_id, model, n_requests, created_at) that matches, drop the submission if none does, report a conflict if
    several do. Only the two latest batches of a model and size decide, so no pairs are formed."""
    fresh = candidates.join(known.select("batch_id"), "batch_id", "left_anti")
    latest = Window.partitionBy("model", "n_requests").orderBy(F.desc("created_at"), F.desc("batch_id"))
    top = fresh.withColumn("_r", F.row_number().over(latest)).filter("_r <= 2")
    two = top.groupBy("model", "n_requests").agg(
        F.max(F.when(F.col("_r") == 1, F.col("batch_id"))).alias("_batch"),
        F.max(F.when(F.col("_r") == 1, F.col("created_at"))).alias("_first"),
        F.max(F.when(F.col("_r") == 2, F.col("created_at"))).alias("_second"),
    )
    earliest = F.col("submitted_at") - F.expr(f"interval {CLOCK_TOLERANCE_SECONDS} seconds")
    joined = unconfirmed.join(two, ["model", "n_requests"], "left")
    action = F.when(F.col("_second") >= earliest, "conflict").when(F.col("_first") >= earliest, "adopt").otherwise("drop")
    decided = joined.withColumn("action", action)
    return decided.withColumn("batch_id", F.when(F.col("action") == "adopt", F.col("_batch"))).drop("_batch", "_first", "_second")


def conditions_from_settings(texts: DataFrame, text: str, known: list[str], default_roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """Conditions of JSON lists of settings, each in its own roles or the default ones, and the entries with unknown
    settings or without a model."""
    schema = "array<map<string,string>>"
    entries = texts.select("*", F.posexplode(F.from_json(text, schema)).alias("position", "entry")).drop(text)
    allowed = F.array(*[F.lit(name) for name in [*known, "roles"]])
    unknown = F.array_sort(F.array_except(F.map_keys("entry"), allowed))
    rule = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown settings "), F.array_join(unknown, ", "))).when(
        F.try_element_at("entry", F.lit("model")).isNull(), F.lit("no model")
    )
    checked = entries.withColumn("rule", rule)
    roles = F.coalesce(F.from_json(F.try_element_at("entry", F.lit("roles")), "array<string>"), F.array(*[F.lit(r) for r in default_roles]))
    values = [F.try_element_at("entry", F.lit(name)).alias(name) for name in known]
    keys = [name for name in texts.columns if name != text]
    good = checked.filter("rule is null").select(*keys, "position", *values, F.explode(roles).alias("role"))
    return good, checked.filter("rule is not null").select(*keys, "position", "rule")


def unit_answers(outputs: DataFrame, units: DataFrame) -> DataFrame:
    """One row per item of an answered unit: ``outputs`` has unit_key and the answers as a JSON object by field name,
    ``units`` one row per unit and item with the item's field."""
    parsed = outputs.withColumn("_fields", F.from_json("output", "map<string,string>")).drop("output")
    return parsed.join(units, "unit_key").withColumn("answer", F.try_element_at("_fields", F.col("field"))).drop("_fields")


def answer_fields(units: DataFrame, unit: list[str], position: str) -> DataFrame:
    """The output field of each item of a unit (unit keys, position from 1): "answer", or "answer_1", "answer_2", ..."""
    sizes = units.groupBy(*unit).agg(F.count("*").alias("_n"))
    field = F.when(F.col("_n") == 1, F.lit("answer")).otherwise(F.concat(F.lit("answer_"), F.col(position).cast("string")))
    return units.join(sizes, unit).withColumn("field", field).drop("_n")


def duplicate_labels(conditions: DataFrame, label: str) -> DataFrame:
    return conditions.groupBy(label).count().filter("count > 1").select(label)


def missing_conditions(levels: dict[str, list[str]], present: DataFrame) -> DataFrame:
    """Combinations of factor levels without a run, and runs that are no combination. The first factor varies slowest."""
    import itertools

    spark = present.sparkSession
    names = list(levels)
    if any(len(set(v)) < 2 or len(set(v)) != len(v) for v in levels.values()):
        raise ValueError(f"Factors need at least two distinct levels: {levels}")
    expected = spark.createDataFrame(list(itertools.product(*levels.values())), names)
    seen = present.select(*names).distinct()
    missing = expected.join(seen, names, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(seen.join(expected, names, "left_anti").withColumn("side", F.lit("not a condition")))

