"""Validation of value scales, model outputs and probability answers: each gives rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The most criteria of a scale, and how far rounded probabilities may sum from 1.
MAX_CRITERIA = 10
SUM_TOLERANCE = 0.05


def scale_violations(criteria: DataFrame) -> DataFrame:
    """(scale, rule) of scales (scale, position, criterion) without 2 to 10 criteria, with a criterion that does not start
    with a number, or whose values do not increase. Only scales of at most 10 criteria are ordered."""
    counts = criteria.groupBy("scale").agg(F.count("*").alias("n"))
    sized = counts.filter(~F.col("n").between(2, MAX_CRITERIA)).select("scale", F.lit("needs 2 to 10 criteria").alias("rule"))
    fitting = criteria.join(counts.filter(F.col("n").between(2, MAX_CRITERIA)).select("scale"), "scale", "left_semi")
    value = F.split_part("criterion", F.lit(" "), F.lit(1)).try_cast("double")
    before = F.lag("value").over(Window.partitionBy("scale").orderBy("position"))
    checked = fitting.withColumn("value", value).withColumn("before", before).groupBy("scale").agg(
        F.sum(F.col("value").isNull().cast("int")).alias("bad"), F.sum(F.coalesce((F.col("value") <= F.col("before")).cast("int"), F.lit(0))).alias("falling")
    )
    rule = F.when(F.col("bad") > 0, "a criterion does not start with its value").when(F.col("falling") > 0, "values do not increase")
    return sized.unionByName(checked.select("scale", rule.alias("rule")).filter("rule is not null"))


def probability_answer_problems(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameter, problem) of probability answers (keys, parameter, position from 0, probability) that do not fit
    their questions (keys, parameter, criteria): missing, unexpected, off the rubric, or not summing to about 1."""
    given = answers.groupBy(*keys, "parameter").agg(
        F.count_distinct("position").alias("_n"), F.min("position").alias("_low"), F.max("position").alias("_high"), F.sum("probability").alias("_sum")
    )
    both = questions.join(given, [*keys, "parameter"], "full_outer")
    support = (F.col("_n") == F.col("criteria")) & (F.col("_low") == 0) & (F.col("_high") == F.col("criteria") - 1)
    problem = (
        F.when(F.col("_n").isNull(), F.concat(F.lit("no answer to "), "parameter"))
        .when(F.col("criteria").isNull(), F.concat(F.lit("unexpected answer "), "parameter"))
        .when(~support, F.concat("parameter", F.lit(" has probabilities off the rubric")))
        .when(F.abs(F.col("_sum") - 1) > SUM_TOLERANCE, F.concat("parameter", F.lit("'s probabilities do not sum to 1")))
    )
    return both.select(*keys, "parameter", problem.alias("problem")).filter("problem is not null")


PREDICTION = "reasoning string, slope double, location double, guessing double, step1 double, step2 double, _broken string"


def prediction_status(text, model, finish_reason, points: Column | int = 2) -> tuple[Column, Column]:
    """The parsed fields of a prediction's JSON text, and why it is unusable, NULL if it is usable. An item of 3
    ``points`` needs a second step; the last one follows from the others."""
    fields = F.from_json(text, PREDICTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    finish, kind = F.col(finish_reason), F.col(model)
    missing = fields["slope"].isNull() | fields["location"].isNull() | ((kind == "3PL") & fields["guessing"].isNull()) | ((kind == "GPCM") & (fields["step1"].isNull() | ((F.lit(points) if isinstance(points, int) else points) > 2) & fields["step2"].isNull()))
    reason = (
        F.when(finish == "length", "cut off")
        .when(F.col(text).isNull() | (F.trim(text) == ""), "no output")
        .when(fields.isNull() | fields["_broken"].isNotNull(), "not the expected JSON")
        .when(missing, "a parameter is missing")
        .when(fields["slope"] < 0, "slope below 0")
        .when((kind == "3PL") & ~fields["guessing"].between(0, 1), "guessing outside 0 to 1")
    )
    return fields, reason


def answer_problems(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of ``answers`` (item_key, field, value and others) with a ``reason`` that they are unusable. ``allowed`` (item_key,
    field, value) lists the fields of an item's output and their values: option letters, categories of the guide, one field per
    part where the guide has parts. A NULL value allows any text. Every kind of output is judged in the same pass."""
    fields = allowed.groupBy("item_key", "field").agg(F.bool_or(F.col("value").isNull()).alias("_any"))
    known = allowed.filter("value is not null").select("item_key", "field", "value", F.lit(True).alias("_known")).distinct()
    joined = answers.join(fields, ["item_key", "field"], "left").join(known, ["item_key", "field", "value"], "left")
    reason = (
        F.when(F.col("_any").isNull(), "unexpected field")
        .when(F.col("value").isNull() | (F.trim("value") == ""), "no output")
        .when(~F.col("_any") & F.col("_known").isNull(), "not an allowed value")
    )
    return joined.withColumn("reason", reason).filter("reason is not null").drop("_any", "_known")


RESPONSE = (
    "id string, choices array<struct<finish_reason: string, message: struct<content: string, reasoning: string, refusal: string>>>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint, completion_tokens_details: struct<reasoning_tokens: bigint>, cost: double>, _broken string"
)


def flat_response(body, context_window: int | None = None) -> dict[str, Column]:
    """A stored chat response as columns: content, reasoning, finish reason, tokens, cost, and why it is unusable."""
    parsed = F.from_json(body, RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    choice = F.try_element_at(parsed["choices"], F.lit(1))
    usage, message = parsed["usage"], choice["message"]
    content, finish = message["content"], choice["finish_reason"]
    full = F.lit(False)
    if context_window is not None:
        full = F.coalesce(usage["prompt_tokens"] + F.coalesce(usage["completion_tokens"], F.lit(0)) >= context_window, F.lit(False))
    reason = (
        F.when(parsed["_broken"].isNotNull() | choice.isNull(), "no response")
        .when(full, "context window is full")
        .when(finish == "length", "cut off")
        .when(content.isNull() | (content == ""), "no content")
    )
    return {
        "content": content, "thinking": message["reasoning"], "finish_reason": finish, "prompt_tokens": usage["prompt_tokens"],
        "completion_tokens": usage["completion_tokens"], "reasoning_tokens": usage["completion_tokens_details"]["reasoning_tokens"],
        "cost_usd": usage["cost"], "unusable": reason,
    }
