"""Prediction errors of runs: baselines, summaries and tables by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.functions.stats import guarded_corr, t_quantile_975
from thetaloom.operators.joins import same_keys
from thetaloom.operators.order_stats import average_ranks, quantiles, unique_index
from thetaloom.session import task_count, written

SCORING = ["grade", "irt_model", "scaled_points"]
ALL = "all"
MEAN_DIGITS = 12


def leave_one_out(items: DataFrame, parameters: list[str], scoring: list[str] = SCORING, part: str = "part_group") -> DataFrame:
    """``items`` with the mean of each parameter over the items scored alike, the item's part group left out, and the
    number of those items (``peers``). Totals of the scoring group minus totals of the part group: no self-join. The totals,
    never the items, are the side that is hashed, and the few scoring groups' are there once for each share of the part
    groups, so that the items of one are not in one task."""

    def totals(keys: list[str], prefix: str) -> DataFrame:
        sums = [f(name).alias(f"_{prefix}_{kind}_{name}") for name in parameters for kind, f in (("n", F.count), ("sum", F.sum))]
        return items.groupBy(*keys).agg(F.count("*").alias(f"_{prefix}"), *sums)

    shares = task_count(items.sparkSession)
    whole = totals(scoring, "all").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))
    joined = same_keys(items, totals([*scoring, part], "part").hint("shuffle_hash"), [*scoring, part])
    joined = same_keys(joined.withColumn("_share", F.pmod(F.xxhash64(part), F.lit(shares))), whole.hint("shuffle_hash"), [*scoring, "_share"])
    means = {"peers": F.col("_all") - F.col("_part")}
    for name in parameters:
        n = F.col(f"_all_n_{name}") - F.col(f"_part_n_{name}")
        rest = F.col(f"_all_sum_{name}") - F.coalesce(F.col(f"_part_sum_{name}"), F.lit(0.0))
        # Rounded, so that equal means tie whatever the order of summation.
        means[f"{name}_mean"] = F.round(F.when(n > 0, rest / n), MEAN_DIGITS)
    return joined.withColumns(means).select(*items.columns, *means)


def error_table(predictions: DataFrame, parameters: list[str], ids: list[str]) -> DataFrame:
    """One row per prediction and predicted parameter from wide columns ``<p>_predicted``, ``<p>_calibrated`` and, where
    present, ``<p>_mean`` and ``<p>_reference``: one pass, no join."""
    names = set(predictions.columns)

    def column(name: str) -> Column:
        return (F.col(name) if name in names else F.lit(None)).cast("double")

    entries = [
        F.struct(
            F.lit(p).alias("parameter"), column(f"{p}_predicted").alias("predicted"), column(f"{p}_calibrated").alias("calibrated"),
            column(f"{p}_mean").alias("calibration_mean"), column(f"{p}_reference").alias("reference_mean"),
        )
        for p in parameters
    ]
    rows = predictions.select(*ids, F.inline(F.array(*entries))).filter("calibrated is not null")
    return rows.withColumn("error", F.col("predicted") - F.col("calibrated"))


def reference_means(references: DataFrame, items: DataFrame, parameters: list[str]) -> DataFrame:
    """Mean of each parameter over the reference items (target_key, item_key) with the target's model and points."""
    alike = ["irt_model", "scaled_points"]
    kind = ["target_key", *alike]
    # The items, few beside the references, are the side that is hashed in both joins, so the references are never sorted.
    # Dealt by target and kind, references of another kind than their target's are gone before anything is summed.
    found = references.select("target_key", "item_key").join(items.select("item_key", *alike, *parameters).hint("shuffle_hash"), "item_key").repartition(*kind)
    target = items.groupBy(F.col("item_key").alias("target_key"), *alike).agg(F.count("*").alias("_times"))
    joined = found.join(target.hint("shuffle_hash"), kind)
    sums = [F.sum(value).alias(f"_{sort}_{name}") for name in parameters for sort, value in (("n", F.when(F.col(name).isNotNull(), F.col("_times"))), ("sum", F.col(name) * F.col("_times")))]
    totals = joined.groupBy(*kind).agg(F.sum("_times").alias("_n"), *sums).groupBy("target_key")
    means = [F.round(F.when(F.sum(f"_n_{name}") > 0, F.sum(f"_sum_{name}") / F.sum(f"_n_{name}")), MEAN_DIGITS).alias(f"{name}_reference") for name in parameters]
    return totals.agg(*means, F.sum("_n").alias("references"))


def with_all(df: DataFrame, by: str) -> DataFrame:
    """Every row twice: once in its group of ``by`` (as text) and once in the group "all"."""
    return df.withColumn(by, F.explode(F.array(F.col(by).cast("string"), F.lit(ALL))))


def correlations(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of the complete pairs of each group, with their number."""
    pairs = written(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, x, y), "pairs")
    ranked = average_ranks(pairs, groups, {x: "_rx", y: "_ry"})
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("pairs"), guarded_corr(F.col(x), F.col(y)).alias("pearson"), guarded_corr(F.col("_rx"), F.col("_ry")).alias("spearman")
    )


def summarize(errors: DataFrame, groups: list[str], baselines: list[str] = ()) -> DataFrame:
    """Items, bias, spread, mean absolute error, RMSE, correlations and the baselines' mean absolute errors per group."""
    rows = written(errors.filter("predicted is not null").select(*groups, "predicted", "calibrated", *baselines), "predictions")
    ranked = average_ranks(rows, groups, {"predicted": "_rp", "calibrated": "_rc"})
    error = F.col("predicted") - F.col("calibrated")
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("items"),
        F.avg(error).alias("mean_error"),
        F.stddev_samp(error).alias("sd_error"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        guarded_corr(F.col("predicted"), F.col("calibrated")).alias("pearson"),
        guarded_corr(F.col("_rp"), F.col("_rc")).alias("spearman"),
        *[F.avg(F.abs(F.col(name) - F.col("calibrated"))).alias(f"mae_{name}") for name in baselines],
    )


def mae_table(errors: DataFrame, groups: list[str], runs: list[str], run: str = "run") -> DataFrame:
    """Mean absolute error per group, one column per run, and the items of the first run."""
    absolute = F.abs(F.col("predicted") - F.col("calibrated"))
    columns = [F.avg(F.when(F.col(run) == name, absolute)).alias(name) for name in runs]
    return errors.groupBy(*groups).agg(F.count(F.when(F.col(run) == runs[0], F.lit(1))).alias("items"), *columns)


def mean_with_interval(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """Mean of ``value`` per group with half the width of its t-based 95% confidence interval, NULL for one row."""
    stats = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    half = F.when(F.col("n") >= 2, t_quantile_975(F.col("n") - 1) * F.col("_sd") / F.sqrt(F.col("n")))
    return stats.select(*groups, "n", "mean", half.alias("half_width"))


def box_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges of the box."""
    box = quantiles(df, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = same_keys(df, box, groups).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    whiskers = inside.groupBy(*groups).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("inside"))
    return same_keys(box, whiskers, groups)


def distribution(df: DataFrame, groups: list[str], value: str, digits: int = 3) -> DataFrame:
    """Count, mean, sd, min, 10%, 50% and 90% quantile and max of a parameter per scoring group."""
    present = df.filter(F.col(value).isNotNull())
    moments = present.groupBy(*groups).agg(
        F.count("*").alias("items"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    table = same_keys(moments, quantiles(present, groups, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), groups)
    return table.select(*groups, "items", *[F.round(name, digits).alias(name) for name in ("mean", "sd", "min", "p10", "p50", "p90", "max")])


def distribution_left_out(
    items: DataFrame, value: str, scoring: list[str] = SCORING, part: str = "part_group", digits: int = 3
) -> DataFrame:
    """The distribution of a parameter that each item is compared with: over the items scored alike, its own part group
    left out. Exact, without a pair of items: moments are totals minus the part group's, and the k-th value of the rest
    is the value at place k of the whole group, moved up by the left-out places before it (a part group is a few items).
    """
    table = items.filter(F.col(value).isNotNull()).select("item_key", *scoring, part, F.col(value).alias("_v"))
    placed = written(unique_index(table, scoring, "_v", "item_key", "_i"), "placed")
    center = placed.groupBy(*scoring).agg(F.avg("_v").alias("_c"))
    centered = same_keys(placed, center, scoring).withColumn("_d", F.col("_v") - F.col("_c"))
    sums = [F.count("*"), F.sum("_d"), F.sum(F.col("_d") * F.col("_d"))]
    whole = centered.groupBy(*scoring, "_c").agg(*[f.alias(f"_w{i}") for i, f in enumerate(sums)])
    own = centered.groupBy(*scoring, part).agg(*[f.alias(f"_p{i}") for i, f in enumerate(sums)], F.array_sort(F.collect_list("_i")).alias("_out"))
    groups = same_keys(own, whole, scoring).filter("_w0 > _p0")
    n, s1, s2 = (F.col(f"_w{i}") - F.col(f"_p{i}") for i in range(3))
    variance = F.when(n > 1, F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))
    groups = groups.withColumns({"peers": n, "mean": F.col("_c") + s1 / n, "sd": F.sqrt(variance)})
    wanted = {"min": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "max": 1.0}

    def moved(place: Column) -> Column:
        return F.aggregate("_out", place.cast("bigint"), lambda k, out: F.when(out <= k, k + 1).otherwise(k))

    position = {name: F.lit(p) * (F.col("peers") - 1) for name, p in wanted.items()}
    entries = [
        F.struct(F.lit(name).alias("_name"), F.lit(up).alias("_up"), moved(F.ceil(at) if up else F.floor(at)).alias("_i"), (at - F.floor(at)).alias("_share"))
        for name, at in position.items()
        for up in (False, True)
    ]
    lookups = same_keys(groups.select(*scoring, part, F.inline(F.array(*entries))), placed.select(*scoring, "_i", "_v"), [*scoring, "_i"])

    def interpolated(name: str) -> Column:
        low, high = (F.max(F.when((F.col("_name") == name) & (F.col("_up") == up), F.col("_v"))) for up in (False, True))
        share = F.max(F.when(F.col("_name") == name, F.col("_share")))
        return (low + share * (high - low)).alias(name)

    values = lookups.groupBy(*scoring, part).agg(*[interpolated(name) for name in wanted])
    shown = same_keys(groups.select(*scoring, part, "peers", "mean", "sd"), values, [*scoring, part])
    rounded = [F.round(name, digits).alias(name) for name in ("mean", "sd", "min", "p10", "p50", "p90", "max")]
    return same_keys(table, shown, [*scoring, part]).select("item_key", "peers", *rounded)
