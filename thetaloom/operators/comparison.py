"""Runs compared on the items every run predicted: common items, baselines as runs, paired tests, effects, agreement."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.functions.posterior import nearest_position
from thetaloom.functions.stats import t_quantile_975, t_two_sided
from thetaloom.sources.files import require_empty

BASELINES = ["calibration_mean", "reference_mean"]
PAIR = ["item_key", "parameter"]


def common_items(errors: DataFrame, n_runs: int) -> DataFrame:
    """The keys of the items that every run predicted. Where they meet rows, they are hashed and the rows not sorted."""
    seen = errors.groupBy("item_key", "run").agg(F.lit(1).alias("_one"))
    return seen.groupBy("item_key").agg(F.count("*").alias("_runs")).filter(F.col("_runs") == n_runs).select("item_key").hint("shuffle_hash")


def check_runs(runs: list[str]) -> None:
    clashes = sorted(set(runs) & set(BASELINES))
    if not runs or clashes or len(set(runs)) != len(runs):
        raise ValueError(f"Give distinct run names other than {BASELINES}, not {runs}")


def disagreements(errors: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Items and parameters on whose calibrated value or calibration mean the runs disagree."""
    names = [name for name in ("calibrated", "calibration_mean") if name in errors.columns]
    spread = [(F.max(name) - F.min(name)).alias(f"{name}_spread") for name in names]
    worst = F.greatest(*[F.coalesce(f"{name}_spread", F.lit(0.0)) for name in names]) if len(names) > 1 else F.col(f"{names[0]}_spread")
    return errors.groupBy(*PAIR).agg(*spread).filter(worst > tolerance)


def stacked(errors: DataFrame, runs: list[str], reference_run: str | None = None, baselines: list[str] = BASELINES) -> DataFrame:
    """The runs' errors on their common items, with each baseline as a run whose prediction is the baseline's value. The
    reference mean of ``reference_run`` stands for every run."""
    check_runs(runs)
    shared = errors.join(common_items(errors.filter(F.col("run").isin(runs)), len(runs)), "item_key", "left_semi")
    if reference_run is not None:
        chosen = errors.filter(F.col("run") == reference_run).select(*PAIR, F.col("reference_mean").alias("_reference"))
        shared = shared.join(chosen.hint("shuffle_hash"), PAIR, "left").withColumn("reference_mean", F.col("_reference")).drop("_reference")
    own = F.struct("run", "predicted")
    as_runs = [F.struct(F.lit(name).alias("run"), F.col(name).alias("predicted")) for name in baselines if name != "reference_mean" or reference_run]
    # The first run's rows give the baselines' in the same pass, so the joins are there once.
    entries = F.when(F.col("run") == runs[0], F.array(own, *as_runs)).otherwise(F.array(own))
    rows = shared.withColumn("_as", F.explode(entries)).withColumns({"run": F.col("_as.run"), "predicted": F.col("_as.predicted")}).drop("_as")
    error = F.col("predicted") - F.col("calibrated")
    return rows.withColumns({"error": error, "abs_error": F.abs(error)})


def wide(
    errors: DataFrame, ids: list[str], runs: list[str], values: tuple[str, ...] = ("predicted", "error"), run: str = "run", first: tuple[str, ...] = ()
) -> DataFrame:
    """One row per ``ids`` with each run's values in columns ``<value> (<run>)``, NULL where the run has none. ``first`` are
    columns taken from the first run's rows, such as the baselines."""
    firsts = [F.max(F.when(F.col(run) == runs[0], F.col(name))).alias(name) for name in first]
    columns = firsts + [F.max(F.when(F.col(run) == name, F.col(value))).alias(f"{value} ({name})") for value in values for name in runs]
    return errors.groupBy(*ids).agg(*columns)


def t_test(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One-sample t-test of ``value`` per group against 0: items, mean, standard error, t, df, p and 95% interval."""
    stats = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("items"), F.avg(value).alias("estimate"), F.stddev_samp(value).alias("_sd")
    )
    several = F.col("items") >= 2
    stats = stats.withColumn("se", F.when(several, F.col("_sd") / F.sqrt("items")))
    stats = stats.withColumn("t", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")))
    stats = stats.withColumn("df", F.when(several, F.col("items") - 1))
    half = t_quantile_975(F.col("df")) * F.col("se")
    return stats.select(
        *groups, "items", "estimate", "se", "t", "df", t_two_sided(F.col("t"), F.col("df")).alias("p_value"),
        (F.col("estimate") - half).alias("ci_low"), (F.col("estimate") + half).alias("ci_high"),
    )


def holm(df: DataFrame, family: list[str], p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment within each family of comparisons; NULL stays NULL and does not count."""
    ordered = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    count = F.count(p).over(Window.partitionBy(*family))
    stepped = F.when(F.col(p).isNotNull(), F.col(p) * (count - F.row_number().over(ordered) + 1))
    running = F.max("_stepped").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    adjusted = F.when(F.col(p).isNotNull(), F.least(running, F.lit(1.0)))
    return df.withColumn("_stepped", stepped).withColumn(out, adjusted).drop("_stepped")


def comparisons(runs: list[str], baselines: list[str]) -> list[tuple[str, str]]:
    return [*itertools.combinations(runs, 2), *itertools.product(runs, baselines)]


def paired(errors: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """t-tests of the per-item differences of absolute errors of each pair of runs, per parameter, Holm-adjusted within
    the parameter. The runs of an item meet in one row, so the pairs are columns and not a join."""
    names = list(dict.fromkeys(name for pair in pairs for name in pair))
    table = wide(errors, PAIR, names, ("abs_error",))
    entries = [
        F.struct(F.lit(f"{a} − {b}").alias("comparison"), (F.col(f"`abs_error ({a})`") - F.col(f"`abs_error ({b})`")).alias("difference"))
        for a, b in pairs
    ]
    long = table.select("parameter", F.inline(F.array(*entries)))
    return holm(t_test(long, ["parameter", "comparison"], "difference"), ["parameter"])


def contrast_weights(factors: dict[str, list[str]]) -> list[tuple[str, str, tuple[str, ...], float]]:
    """(effect, comparison, levels, weight) of main effects and interactions of two-level factors."""
    if any(len(set(levels)) != 2 for levels in factors.values()):
        raise ValueError("Effects need factors of two distinct levels")
    names, rows = list(factors), []
    for size in range(1, len(names) + 1):
        for term in itertools.combinations(names, size):
            if size == 1:
                comparison = f"{factors[term[0]][1]} − {factors[term[0]][0]}"
            elif size == 2:
                first, second = factors[term[0]]
                comparison = f"{term[1]} effect with {second} − {term[1]} effect with {first}"
            else:
                comparison = "interaction contrast of " + ", ".join(term)
            for levels in itertools.product(*factors.values()):
                chosen = dict(zip(names, levels))
                sign = 1
                for name in term:
                    sign *= 1 if chosen[name] == factors[name][1] else -1
                rows.append((" × ".join(term), comparison, levels, sign / 2 ** (len(names) - size)))
    return rows


def factorial_effects(errors: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """Main effects and interactions on the absolute error, from per-item contrasts over the conditions, on the items
    that every condition predicted. ``errors`` has one column per factor."""
    names = list(factors)
    conditions = list(itertools.product(*factors.values()))
    labelled = errors.withColumn("run", F.concat_ws(", ", *names))
    shared = labelled.join(common_items(labelled, len(conditions)), "item_key", "left_semi")
    weights = contrast_weights(factors)
    terms = list(dict.fromkeys((effect, comparison) for effect, comparison, _, _ in weights))
    absolute = F.abs(F.col("predicted") - F.col("calibrated"))

    def contrast(effect: str) -> Column:
        weight = F.lit(None).cast("double")
        for term, _, levels, value in weights:
            if term == effect:
                weight = F.when(F.col("run") == ", ".join(levels), F.lit(value)).otherwise(weight)
        return F.sum(weight * absolute)

    sums = shared.groupBy(*PAIR).agg(*[contrast(effect).alias(f"_c{i}") for i, (effect, _) in enumerate(terms)])
    entries = [
        F.struct(F.lit(effect).alias("effect"), F.lit(comparison).alias("comparison"), F.col(f"_c{i}").alias("contrast"))
        for i, (effect, comparison) in enumerate(terms)
    ]
    long = sums.select("parameter", F.inline(F.array(*entries)))
    return t_test(long, ["parameter", "effect", "comparison"], "contrast")


def scale_choices(errors: DataFrame, scales: dict[str, list[float]], mode: str | None = None) -> DataFrame:
    """Each prediction as a category of its parameter's scale (from 1), and the calibrated value's. A prediction with a
    most likely value (``mode``) takes that; ``on_scale`` tells whether it is a value of the scale."""
    grid = F.lit(None).cast("array<double>")
    for name, values in scales.items():
        grid = F.when(F.col("parameter") == name, F.array(*[F.lit(float(v)) for v in values])).otherwise(grid)
    value = F.coalesce(F.col(mode), F.col("predicted")) if mode else F.col("predicted")
    chosen = errors.filter(F.col("parameter").isin(list(scales))).withColumn("_grid", grid)
    chosen = chosen.withColumns(
        {
            "category": nearest_position(value, F.col("_grid")) + 1,
            "calibrated_category": nearest_position(F.col("calibrated"), F.col("_grid")) + 1,
        }
    )
    picked = F.element_at("_grid", F.col("category"))
    on_scale = (F.col(mode).isNull() | (F.abs(picked - F.col(mode)) <= 1e-8 + 1e-5 * F.abs(F.col(mode)))) if mode else F.lit(True)
    return chosen.withColumns(
        {"value": picked, "calibrated_value": F.element_at("_grid", F.col("calibrated_category")), "on_scale": on_scale}
    ).drop("_grid")


def require_on_scale(choices: DataFrame) -> None:
    """Raise where a most likely value is none of its parameter's scale, or a prediction is missing: the scales are others."""
    wrong = choices.filter(~F.col("on_scale") | F.col("category").isNull())
    require_empty(wrong.groupBy("run", "parameter").count(), "Values that are not on the comparison's scale (run, parameter, items)")


def category_counts(choices: DataFrame, groups: list[str], first: str = "calibrated_category", second: str = "category") -> DataFrame:
    """Counts of each pair of categories per group: all agreement measures follow from this small table."""
    return choices.filter(F.col(second).isNotNull()).groupBy(*groups, first, second).agg(F.count("*").alias("n"))


def agreement(choices: DataFrame, groups: list[str], first: str = "calibrated_category", second: str = "category") -> DataFrame:
    """Exact and within-one agreement and quadratic weighted kappa per group. With weights (i - j)^2 the expected
    disagreement follows from the first two moments of both ratings, so kappa needs no category-pair table."""
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    distance = F.abs(a - b)
    observed = F.sum(distance * distance)
    expected = F.sum(a * a) + F.sum(b * b) - 2 * F.sum(a) * F.sum(b) / F.count("*")
    varied = (F.min(F.least(a, b)) < F.max(F.greatest(a, b)))
    return choices.filter(F.col(second).isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("items"),
        F.avg((distance == 0).cast("double")).alias("exact"),
        F.avg((distance <= 1).cast("double")).alias("within_one"),
        F.when(varied, 1 - observed / expected).alias("weighted_kappa"),
    )


def best_constant(choices: DataFrame, groups: list[str], n_categories: int, category: str = "calibrated_category") -> DataFrame:
    """Shares of the best constant category: the one exact, and, chosen separately, the one within one most often."""
    c = F.col(category)
    exact = [F.avg((c == k).cast("double")) for k in range(1, n_categories + 1)]
    near = [F.avg((F.abs(c - k) <= 1).cast("double")) for k in range(1, n_categories + 1)]
    return choices.groupBy(*groups).agg(F.greatest(*exact).alias("baseline_exact"), F.greatest(*near).alias("baseline_within_one"))


def value_spread(choices: DataFrame, scales: dict[str, list[float]], runs: list[str]) -> DataFrame:
    """How often each scale value is picked by the calibrated values (of the first run) and by every run, 0 included."""
    truth = choices.filter(F.col("run") == runs[0]).select("parameter", F.lit("calibrated").alias("source"), F.col("calibrated_value").alias("value"))
    picked = truth.unionByName(choices.select("parameter", F.col("run").alias("source"), "value"))
    columns = [F.count(F.when(F.col("source") == name, 1)).alias(name) for name in ["calibrated", *runs]]
    counts = picked.groupBy("parameter", "value").agg(*columns)
    spark = choices.sparkSession
    full = spark.createDataFrame([(p, float(v)) for p, values in scales.items() for v in values], "parameter string, value double")
    return full.join(counts, ["parameter", "value"], "left").fillna(0, ["calibrated", *runs])


def confusion(choices: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of truth x picked category with the share of the true category's items."""
    counts = category_counts(choices, groups)
    total = F.sum("n").over(Window.partitionBy(*groups, "calibrated_category"))
    return counts.withColumn("share", F.col("n") / total)
