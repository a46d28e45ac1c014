"""Prompts, questions and request bodies as tables. The wording is a parameter: templates fill ``{name}`` with columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.functions.scoring import predicted_parameters

# How parameters are called in prompts.
PARAMETER_LABELS = {"slope": "slope (a)", "location": "location (b)", "guessing": "guessing (c)", "step1": "step 1 (d_1)", "step2": "step 2 (d_2)", "step3": "step 3 (d_3)"}

UNIT_WORDING = {"heading": "### {i} of {n}", "opening": "Work through all {n} questions below in order.", "closing": "Give {n} answers, one for each question."}
"""How several questions are framed; a caller gives its own."""
FIGURE_WORDING = "[Figure] {figure}"


def filled(template: str, columns: dict[str, Column] | None = None) -> Column:
    """A template as a string column: each ``{name}`` is the column of that name, or one of ``columns``."""
    parts = []
    for number, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if number % 2:
            column = (columns or {}).get(part, F.col(part))
            parts.append(F.coalesce(column.cast("string"), F.lit("")))
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts) if parts else F.lit("")


def by_value(column: str, templates: dict, columns: dict[str, Column] | None = None) -> Column:
    """The template of each value of a column, such as one opening per grade and role."""
    result = F.lit(None).cast("string")
    for value, template in templates.items():
        result = F.when(F.col(column) == value, filled(template, columns)).otherwise(result)
    return result


def question_text(stem, figure, options: Column, figure_wording: str = FIGURE_WORDING) -> Column:
    """An item as the test shows it: stem, figure in words, options. Never its ID, key, guide or statistics."""
    shown = F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")
    described = F.when(F.col(figure) != "", filled(figure_wording, {"figure": F.col(figure)}))
    return F.concat_ws("\n\n", F.col(stem), described, F.nullif(shown, F.lit("")))


def unit_prompts(items: DataFrame, unit: str, position: str, question: str, wording: dict[str, str] = UNIT_WORDING) -> DataFrame:
    """One prompt per unit (the few items a student sees together): the question alone, or an opening, the questions in
    booklet order with a heading each, and a closing."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(question).alias("q"))))
    grouped = items.groupBy(unit).agg(ordered.alias("_q"))
    n = F.size("_q")
    numbered = F.transform("_q", lambda e, i: F.concat(filled(wording["heading"], {"i": i + 1, "n": n}), F.lit("\n\n"), e["q"]))
    several = F.concat_ws("\n\n", filled(wording["opening"], {"n": n}), F.array_join(numbered, "\n\n"), filled(wording["closing"], {"n": n}))
    return grouped.select(unit, n.alias("questions"), F.when(n == 1, F.element_at("_q", 1)["q"]).otherwise(several).alias("user_prompt"))


def leaks(prompts: DataFrame, items: DataFrame, unit: str, fields: list[str]) -> DataFrame:
    """Prompts that contain a field of their items that a test taker must not see, such as the item ID."""
    joined = prompts.join(items.select(unit, *fields), unit)
    found = F.array_compact(F.array(*[F.when(F.contains("user_prompt", F.col(f)), F.lit(f)) for f in fields]))
    return joined.select(unit, F.explode(found).alias("field"))


def parameters_text(names: Column, values: dict[str, str]) -> Column:
    """Calibrated parameters as "slope (a) = 0.927, location (b) = 0.111"."""
    entries = [
        F.when(F.array_contains(names, name), F.concat(F.lit(f"{PARAMETER_LABELS[name]} = "), F.format_string("%.3f", F.col(column))))
        for name, column in values.items()
    ]
    return F.concat_ws(", ", *entries)


def reference_blocks(references: DataFrame, block: Column, top: int, order: tuple[str, ...]) -> DataFrame:
    """The blocks of each target's first ``top`` reference items by ``order``, which has no ties. The cut is made before
    anything is collected, so a target may have any number of references."""
    place = F.row_number().over(Window.partitionBy("target_key").orderBy(*order))
    first = references.select("target_key", *order, block.alias("block")).withColumn("rank", place).filter(F.col("rank") <= top)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return first.groupBy("target_key").agg(F.array_join(F.transform(ordered, lambda e: e["block"]), "\n\n").alias("reference_text"))


def guide_text(categories: DataFrame) -> DataFrame:
    """The scoring guide of each item with the points of each category, in the order of the guide."""
    points = F.concat(F.col("points").cast("string"), F.when(F.col("points") == 1, F.lit(" point")).otherwise(F.lit(" points")))
    line = F.concat(F.lit("- "), "category", F.lit(" ("), points, F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return categories.groupBy("item_key").agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("guide"))


def scale_questions(items: DataFrame, scales: dict[str, list[str]], questions: dict[str, str], state: list[str]) -> DataFrame:
    """One question per item and predicted parameter with the criteria of its scale, and the item's state as JSON of its
    non-null fields, without its ID."""
    parameter = F.explode(predicted_parameters("irt_model", "scaled_points"))
    rows = items.select("item_key", F.to_json(F.struct(*state)).alias("state"), parameter.alias("parameter"))
    criteria = F.lit(None).cast("array<string>")
    for name, values in scales.items():
        criteria = F.when(F.col("parameter") == name, F.array(*[F.lit(v) for v in values])).otherwise(criteria)
    return rows.withColumns({"question": by_value("parameter", questions), "criteria": criteria})


def request_bodies(prompts: DataFrame, request_id: str, model: str, max_tokens: int, schema: str | None = None) -> DataFrame:
    """One JSON line per request: its ID and the chat body."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")), F.struct(F.lit("user").alias("role"), F.col("user_prompt").alias("content"))
    )
    body = [messages.alias("messages"), F.col(model).alias("model"), F.lit(max_tokens).alias("max_tokens")]
    if schema is not None:
        body.append(F.col(schema).alias("response_format"))
    return prompts.select(F.to_json(F.struct(F.col(request_id).cast("string").alias("custom_id"), F.struct(*body).alias("body"))).alias("value"))


def write_request_bodies(lines: DataFrame, path: str) -> None:
    """Request lines as text files, one folder per chunk if the lines have one."""
    writer = lines.write
    (writer.partitionBy("chunk") if "chunk" in lines.columns else writer).text(path)
