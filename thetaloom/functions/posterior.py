"""Point predictions and spread of a discrete answer over the values of a scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def posterior(probabilities: Column, values: Column) -> Column:
    """A struct of map, map_probability, eap, median and sd. The probabilities are first scaled to sum to 1; ``map`` is
    the lowest of the most likely values, ``median`` the lowest value with a cumulative probability of 0.5, or the
    midpoint with the next value where it is exactly 0.5. NULL if the probabilities do not fit the values."""
    zero = F.lit(0.0)
    total = F.aggregate(probabilities, zero, lambda sum_, p: sum_ + p)
    fits = (F.size(probabilities) == F.size(values)) & ~F.exists(probabilities, lambda p: p < 0) & (total > 0)
    p = F.transform(probabilities, lambda value: value / total)
    mode = F.array_position(p, F.array_max(p)).cast("int")
    eap = F.aggregate(F.zip_with(p, values, lambda a, v: a * v), zero, lambda sum_, x: sum_ + x)
    spread = F.aggregate(F.zip_with(p, values, lambda a, v: a * (v - eap) * (v - eap)), zero, lambda sum_, x: sum_ + x)

    # Running sums, then the first position that reaches one half.
    running = F.aggregate(
        p,
        F.array().cast("array<double>"),
        lambda sums, x: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), zero) + x)),
    )
    middle = F.array_position(F.transform(running, lambda c: c >= 0.5 - TOLERANCE), F.lit(True)).cast("int")
    at = F.element_at(values, middle)
    exact = (F.abs(F.element_at(running, middle) - 0.5) <= TOLERANCE) & (middle < F.size(values))
    median = F.when(exact, (at + F.try_element_at(values, middle + 1)) / 2).otherwise(at)
    return F.when(
        fits,
        F.struct(
            F.element_at(values, mode).alias("map"),
            F.element_at(p, mode).alias("map_probability"),
            eap.alias("eap"),
            median.alias("median"),
            F.sqrt(spread).alias("sd"),
        ),
    )


def nearest_position(value: Column, grid: Column) -> Column:
    """0-based position of the grid value closest to ``value``, the lowest on ties; NULL stays NULL."""
    distance = F.transform(grid, lambda point: F.abs(point - value))
    return (F.array_position(distance, F.array_min(distance)) - 1).cast("int")
