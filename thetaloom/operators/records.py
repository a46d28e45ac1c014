"""Stacking, reshaping and settings of runs and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thetaloom.operators.comparison import common_items

def crossed(df: DataFrame, conditions: DataFrame, order: list[str]) -> DataFrame:
    """Every row of ``df`` with every condition, numbered in their order. The conditions are settings, few next to the
    rows; adaptive execution broadcasts them if they measure so, and joins them in blocks otherwise."""
    numbered = conditions.withColumn("condition_order", F.row_number().over(Window.orderBy(*order)) - 1)
    return df.crossJoin(numbered.select("condition_order", *conditions.columns))


def with_factors(errors: DataFrame, factors: dict[str, list[str]], n_conditions: int) -> DataFrame:
    """Errors with the condition's label, the absolute error, and whether every condition predicted the item."""
    labelled = errors.withColumns({"run": F.concat_ws(", ", *factors), "abs_error": F.abs(F.col("predicted") - F.col("calibrated"))})
    shared = common_items(labelled, n_conditions).withColumn("in_all_conditions", F.lit(True))
    joined = labelled.join(shared, "item_key", "left")
    return joined.withColumnRenamed("run", "condition").withColumn("in_all_conditions", F.coalesce("in_all_conditions", F.lit(False)))


def ordinal(column: str, values: list) -> Column:
    """The place of a value in a fixed order of categories, to sort by."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested structs as one level of columns named by their path."""

    def walk(fields: T.StructType, prefix: str) -> list[Column]:
        result = []
        for field in fields:
            path = f"{prefix}{field.name}"
            quoted = ".".join(f"`{part}`" for part in path.split("."))
            if isinstance(field.dataType, T.StructType):
                result += walk(field.dataType, f"{path}.")
            else:
                result.append(F.col(quoted).alias(path))
        return result

    return df.select(*walk(df.schema, ""))


def setting_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, setting, value as JSON) of every nested setting of each run."""
    flat = flat_columns(df)
    names = [name for name in flat.columns if name != key]

    def as_json(name: str) -> Column:
        text = F.to_json(F.struct(F.col(f"`{name}`").alias("v")), {"ignoreNullFields": "false"})
        return F.regexp_extract(text, r'^\{"v":(.*)\}$', 1)

    entries = [F.struct(F.lit(name).alias("setting"), as_json(name).alias("value")) for name in names]
    return flat.select(key, F.inline(F.array(*entries)))


def settings_matrix(rows: DataFrame, key: str, runs: list) -> DataFrame:
    """One row per setting, one column per run."""
    return rows.groupBy("setting").agg(*[F.max(F.when(F.col(key) == run, F.col("value"))).alias(str(run)) for run in runs])


def pivoted(df: DataFrame, index: list[str], column: str, values: list, cell: Column, names: list[str] | None = None) -> DataFrame:
    """``cell`` of each value of ``column`` side by side, NULL where there is none."""
    return df.groupBy(*index).agg(*[F.max(F.when(F.col(column) == v, cell)).alias(n) for v, n in zip(values, names or [str(v) for v in values])])


def record_assembly(items: DataFrame, calibrations: DataFrame, parts: DataFrame, references: DataFrame) -> DataFrame:
    """One prediction record per item: its fields, the calibration its prediction targets, the keys left out of its
    context, and its reference items in rank order (a bounded list per item)."""
    excluded = parts.groupBy("target_key").agg(F.array_sort(F.collect_set("part_key")).alias("excluded_item_keys"))
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item_key", "found_by"))),
        lambda e: F.concat(e["rank"].cast("string"), F.lit(":"), e["item_key"], F.lit(":"), e["found_by"]),
    )
    similar = references.groupBy("target_key").agg(entries.alias("similar_items"))
    keyed = items.withColumn("target_key", F.col("item_key"))
    return keyed.join(calibrations, "grade", "left").join(excluded, "target_key", "left").join(similar, "target_key", "left").drop("target_key")
