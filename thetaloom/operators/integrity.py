"""Grouping of items that belong together, lookups between items and parameters, and checks that return violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.functions.keys import base_item_id
from thetaloom.functions.scoring import category_points

# A category that names its part, and the tolerance of the sum of the steps.
PART_CATEGORY = r"^(M\d{6}[A-Z]) (.+)$"
STEP_TOLERANCE = 0.002


def drop_duplicates_checked(items: DataFrame, duplicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items without the listed duplicates (item_key, original_key), and the violations: a listed item whose text no
    longer repeats its original's, a blank text, or another text that repeats. Texts are compared by their hash."""
    hashed = items.select("item_key", F.sha2("text", 256).alias("hash"), (F.trim("text") == "").alias("blank"))
    original = hashed.select(F.col("item_key").alias("original_key"), F.col("hash").alias("original_hash"))
    changed = (
        duplicates.join(hashed, "item_key", "left").join(original, "original_key", "left")
        .filter(~F.col("hash").eqNullSafe(F.col("original_hash")))
        .select("item_key", F.lit("no longer repeats its original").alias("rule"))
    )
    kept = hashed.join(duplicates.select("item_key"), "item_key", "left_anti")
    blank = kept.filter("blank").select("item_key", F.lit("no text").alias("rule"))
    # Repeats of a hot text are counted with partial sums; only hashes that repeat go into the join.
    again = kept.groupBy("hash").count().filter("count > 1").select("hash")
    repeats = kept.join(again, "hash", "left_semi").select("item_key", F.lit("text repeats").alias("rule"))
    clean = items.join(duplicates.select("item_key"), "item_key", "left_anti")
    return clean, changed.unionByName(blank).unionByName(repeats)


def part_groups(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """``items`` with ``part_group``: items of one assessment and grade with the same base ID, or of one listed task
    (assessment, grade, base_id, task), are parts of one group."""
    based = items.withColumn("base_id", base_item_id("item_id"))
    keys = ["assessment", "grade", "base_id"]
    joined = based.join(tasks, keys, "left")
    return joined.withColumn("part_group", F.concat_ws("/", "assessment", "grade", F.coalesce("task", "base_id"))).drop("base_id", "task")


def units(items: DataFrame) -> DataFrame:
    """One row per part group with a calibrated item, its item IDs in booklet order joined by "+", its first position
    and its numbers of items. A group is the few items a student sees together."""
    return (
        items.groupBy("part_group")
        .agg(
            F.min("position").alias("first_position"),
            F.count("*").alias("items"),
            F.sum(F.col("calibrated").cast("int")).alias("calibrated_items"),
            F.expr("listagg(item_id, '+') within group (order by position)").alias("item_ids"),
            F.first("assessment").alias("assessment"),
            F.first("grade").alias("grade"),
            F.first("subject").alias("subject"),
        )
        .filter("calibrated_items > 0")
        .select(
            F.concat_ws("/", "assessment", F.concat(F.lit("grade "), F.col("grade")), "subject", "item_ids").alias("unit_key"),
            "part_group", "grade", "assessment", "first_position", "items", "calibrated_items",
        )
    )


def parameter_payload(items: DataFrame, parameters: DataFrame, names: list[str]) -> DataFrame:
    """Items with their parameters as a struct, NULL for an item without parameters."""
    payload = parameters.select("item_key", F.struct(*names).alias("item_parameters"))
    return items.join(payload, "item_key", "left")


def calibration_lookup(parameters: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The calibration of each group of ``keys``, and the groups with more than one."""
    found = parameters.groupBy(*keys).agg(F.min("calibration").alias("calibration"), F.max("calibration").alias("_last"))
    return found.filter("calibration = _last").drop("_last"), found.filter("calibration <> _last").drop("_last")


def metadata_filter(df: DataFrame, **conditions) -> Column:
    """A predicate from field=value, field=[values] or field=None (no condition); a dotted path reaches into a struct.
    Written with "__" for the dot: item_parameters__irt_model="GPCM"."""
    paths = {name.replace("__", "."): value for name, value in conditions.items()}
    unknown = sorted({path.split(".")[0] for path in paths} - set(df.columns))
    if unknown:
        raise ValueError(f"Unknown fields {unknown}; the fields are {sorted(df.columns)}")
    tests = [
        F.col(path).isin(value) if isinstance(value, list | tuple | set) else F.col(path) == F.lit(value)
        for path, value in paths.items()
        if value is not None
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def guide_categories(guides: DataFrame) -> DataFrame:
    """Categories of a scoring guide (item_key, max_points, position, category) with their part and points; a category
    that names its part counts 1 point at most."""
    part = F.nullif(F.regexp_extract("category", PART_CATEGORY, 1), F.lit(""))
    name = F.when(part.isNull(), F.col("category")).otherwise(F.regexp_extract("category", PART_CATEGORY, 2))
    top = F.when(part.isNull(), F.col("max_points")).otherwise(F.lit(1))
    return guides.withColumns({"part": part, "points": category_points(name, top)})


def guide_violations(guides: DataFrame) -> DataFrame:
    """Items whose guide mixes categories with and without part, has a number of parts other than its points, has a
    category without points, or does not give every score from 0 to the top."""
    categories = guide_categories(guides)
    by_part = categories.groupBy("item_key", "max_points", "part").agg(
        F.collect_set("points").alias("scores"), F.sum(F.col("points").isNull().cast("int")).alias("without")
    )
    top = F.when(F.col("part").isNull(), F.col("max_points")).otherwise(F.lit(1)).cast("int")
    complete = F.sort_array("scores") == F.sequence(F.lit(0), top)
    items = by_part.groupBy("item_key", "max_points").agg(
        F.count("part").alias("parts"), F.count("*").alias("groups"), F.sum("without").alias("without"), F.min(complete).alias("complete")
    )
    single = (F.col("parts") == 0) & (F.col("groups") == 1)
    whole = (F.col("parts") == F.col("groups")) & (F.col("parts") == F.col("max_points"))
    rule = (
        F.when(F.col("without") > 0, "a category has no points")
        .when(~(single | whole), "parts do not fit the points")
        .when(~F.col("complete"), "not every score is given")
    )
    return items.withColumn("rule", rule).filter("rule is not null").select("item_key", "rule")


def item_violations(items: DataFrame) -> DataFrame:
    """(item_key, rule) of items whose format, options, key and points do not fit: the key is one of the labels, labels are
    distinct, only multiple choice has options, and a calibration gives no more points than the item has."""
    col, labels = F.col, F.col("options.label")
    choice = col("item_type") == "multiple_choice"
    rules = {
        "the key is not among the options": choice & ~F.coalesce(F.array_contains(labels, col("correct_option")), F.lit(False)),
        "labels repeat": F.size(F.array_distinct(labels)) < F.size(labels),
        "options or a key without a choice": ~choice & (col("options").isNotNull() | col("correct_option").isNotNull()),
        "more points in the scaling than the item has": col("scaled_points") > col("max_points"),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return items.select("item_key", F.explode(broken).alias("rule"))


def parameter_violations(parameters: DataFrame, tolerance: float = STEP_TOLERANCE) -> DataFrame:
    """(rule, key) of parameter rows that break a rule: the model fits format and points; each model has exactly its
    parameters; the steps sum to 0. All rules are columns of one pass over the table."""
    col = F.col
    has = {name: col(name).isNotNull() for name in ("slope", "location", "guessing", "step1", "step2", "step3")}
    fits = F.when(col("item_type") == "multiple_choice", "3PL").when(col("scaled_points") == 1, "2PL").otherwise("GPCM")
    core = has["slope"] & has["location"]
    exact = (
        F.when(col("irt_model") == "3PL", core & has["guessing"] & ~has["step1"])
        .when(col("irt_model") == "2PL", core & ~has["guessing"] & ~has["step1"])
        .otherwise(core & ~has["guessing"] & has["step1"] & has["step2"] & (has["step3"] == (col("scaled_points") == 3)))
    )
    steps = sum((F.coalesce(name, F.lit(0.0)) for name in ("step2", "step3")), F.coalesce("step1", F.lit(0.0)))
    rules = {
        "model does not fit the format": col("irt_model") != fits,
        "not exactly the parameters of the model": ~exact,
        "steps do not sum to 0": (col("irt_model") == "GPCM") & (F.abs(steps) > tolerance),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return parameters.select("item_key", F.explode(broken).alias("rule"))
