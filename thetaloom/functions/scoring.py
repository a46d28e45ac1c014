"""Models, points and parameters of items, and the points of scoring categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters in their order.
PARAMETER_NAMES = ["slope", "location", "guessing", "step1", "step2", "step3"]
STEP_NAMES = ["step1", "step2", "step3"]


def irt_model(item_type, points: Column) -> Column:
    """3PL for multiple choice, 2PL for a 1-point and GPCM for a polytomous constructed response."""
    return F.when(F.col(item_type) == "multiple_choice", "3PL").when(points == 1, "2PL").otherwise("GPCM")


def model_parameters(model, points) -> Column:
    """The parameter names of an item."""
    model, points = F.col(model), F.col(points)
    steps = F.slice(F.array(*[F.lit(name) for name in STEP_NAMES]), F.lit(1), points.cast("int"))
    base = F.array(F.lit("slope"), F.lit("location"))
    return F.when(model == "3PL", F.array(F.lit("slope"), F.lit("location"), F.lit("guessing"))).when(model == "2PL", base).otherwise(
        F.concat(base, steps)
    )


def predicted_parameters(model, points) -> Column:
    """All parameters but the last step of a GPCM item, which is minus the sum of the others."""
    names = model_parameters(model, points)
    return F.when(F.col(model) == "GPCM", F.slice(names, F.lit(1), F.size(names) - 1)).otherwise(names)


def last_step(points, *steps: str) -> Column:
    """Minus the sum of the predicted steps of a GPCM item worth ``points``."""
    total = F.lit(0.0)
    for number, step in enumerate(steps, 1):
        total = total + F.when(F.col(points) > number, F.coalesce(F.col(step), F.lit(0.0))).otherwise(0.0)
    return -total


def valid_format(item_type, labels: Column, correct_option, points: Column) -> Column:
    """Multiple choice: at least two options, the key among them, 1 point; otherwise no options and no key."""
    key = F.col(correct_option)
    choice = F.coalesce((F.size(labels) >= 2) & F.array_contains(labels, key) & (points == 1), F.lit(False))
    open_ended = (F.coalesce(F.size(labels), F.lit(0)) <= 0) & (key.isNull() | (key == ""))
    return F.when(F.col(item_type) == "multiple_choice", choice).otherwise(open_ended)


def category_points(category, max_points: Column) -> Column:
    """Points of a scoring category by its first word; NULL for a category without points."""
    name = F.lower(F.col(category) if isinstance(category, str) else category)

    def starts(*prefixes: str) -> Column:
        result = name.startswith(prefixes[0])
        for prefix in prefixes[1:]:
            result = result | name.startswith(prefix)
        return result

    return (
        F.when(starts("incorrect", "nonresponse", "non response"), F.lit(0))
        .when(starts("minimal") & (max_points == 3), F.lit(1))
        .when(starts("partial") & (max_points >= 2), max_points - 1)
        .when(starts("correct", "fully correct"), max_points)
        .cast("int")
    )
