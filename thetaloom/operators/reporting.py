"""The reporting scale of a calibration and the tables of scores on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The benchmarks of the reporting scale, the last not used for grade 12.
BENCHMARKS = [(625, "Advanced"), (550, "High"), (475, "Intermediate"), (400, "Low")]
BELOW = "below the lowest benchmark"


def scale_score(theta: Column, a: Column, b: Column) -> Column:
    return a + b * theta


def benchmark(score: Column, grade: Column) -> Column:
    """The highest benchmark that a scale score reaches."""
    result = None
    for cut, name in BENCHMARKS:
        reached = score >= cut
        if name == "Low":
            reached = reached & (grade != 12)
        label = F.lit(f"{name} ({cut})")
        result = F.when(reached, label) if result is None else result.when(reached, label)
    return result.otherwise(F.lit(BELOW))


def scale_constants(constants: DataFrame, per_calibration: int = 5) -> tuple[DataFrame, DataFrame]:
    """The mean A and B of each calibration's scoring rows, and the calibrations without exactly ``per_calibration``."""
    rows = constants.filter("use_for_scoring").groupBy("calibration").agg(
        F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("plausible_values"),
        F.min(F.split_part("method", F.lit(":"), F.lit(1))).alias("constants"),
    )
    complete = F.col("plausible_values") == per_calibration
    return rows.filter(complete), rows.filter(~complete)


def overall_scores(estimates: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Estimates of theta with the percent of points, the reporting scale and the benchmark reached. ``calibrations``
    has one row per calibration: grade, a, b and calibration_items."""
    table = estimates.join(calibrations, "calibration")
    eap = scale_score(F.col("theta_eap"), F.col("a"), F.col("b"))
    return table.withColumns(
        {
            "percent_of_points": 100 * F.col("points") / F.col("max_points"),
            "scale_eap": eap,
            "scale_eap_se": F.col("b") * F.col("theta_eap_se"),
            "scale_mle": scale_score(F.col("theta_mle"), F.col("a"), F.col("b")),
            "scale_mle_se": F.col("b") * F.col("theta_mle_se"),
            "scale_benchmark": benchmark(eap, F.col("grade")),
        }
    )


def calibration_items(items: DataFrame) -> DataFrame:
    """Items and grade of each calibration."""
    return items.groupBy("calibration").agg(F.first("grade").alias("grade"), F.count("*").alias("calibration_items"))


def largest_calibration(items: DataFrame) -> int:
    """The most items of a calibration: a bound of the responses of one respondent on it, since a respondent has one
    response per item."""
    return items.groupBy("calibration").count().agg(F.max("count")).first()[0] or 0
