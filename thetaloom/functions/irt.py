"""Item response models as ``Column`` expressions over the parameter columns of an item.

3PL: c + (1 - c) / (1 + exp(-1.7 a (theta - b))); 2PL: the same with c = 0; GPCM: P(k) proportional to
exp(sum over v <= k of 1.7 a (theta - b + d_v)), d_0 = 0. Everything is plain arithmetic, so a projection or an
aggregation over a (response x grid) table stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scaling constant, the ability grid and the floor of a probability.
SCALING = 1.7
THETA_MIN, THETA_MAX, THETA_STEP = -6.0, 6.0, 0.01
PROBABILITY_FLOOR = 1e-300
MAX_STEPS = 3


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


class ItemModel:
    """The model of the item in each row, from columns named as in the parameter table."""

    def __init__(self, prefix: str = "", steps: int = MAX_STEPS):
        column = lambda name: F.col(f"{prefix}{name}")
        self.gpcm = column("irt_model") == "GPCM"
        self.slope, self.location = column("slope"), column("location")
        self.guessing = F.coalesce(column("guessing"), F.lit(0.0))
        self.steps = [column(f"step{number}") for number in range(1, steps + 1)]

    def logistic(self, theta) -> Column:
        return 1 / (1 + F.exp(-SCALING * self.slope * (_column(theta) - self.location)))

    def correct(self, theta) -> Column:
        """P(correct) of a dichotomous item."""
        return self.guessing + (1 - self.guessing) * self.logistic(theta)

    def _weights(self, theta) -> list[Column]:
        """Unnormalised GPCM weights of scores 0, 1, ..., shifted by their maximum; NULL above the item's points."""
        terms, total = [F.lit(0.0)], F.lit(0.0)
        for step in self.steps:
            total = total + SCALING * self.slope * (_column(theta) - self.location + step)
            terms.append(total)
        top = F.greatest(*terms)
        return [F.exp(term - top) for term in terms]

    def probabilities(self, theta) -> list[Column]:
        """P(score = k) for k = 0, 1, ...; NULL for scores above the item's points."""
        weights = self._weights(theta)
        total = sum((F.coalesce(weight, F.lit(0.0)) for weight in weights[1:]), weights[0])
        correct = self.correct(theta)
        dichotomous = [1 - correct, correct] + [F.lit(None).cast("double")] * (len(weights) - 2)
        return [F.when(self.gpcm, weight / total).otherwise(other) for weight, other in zip(weights, dichotomous)]

    def score_probability(self, theta, score="score") -> Column:
        """P(the observed score); NULL for a score above the item's points."""
        weights = self._weights(theta)
        total = sum((F.coalesce(weight, F.lit(0.0)) for weight in weights[1:]), weights[0])
        picked = F.when(_column(score) == 0, weights[0])
        for value, weight in enumerate(weights[1:], 1):
            picked = picked.when(_column(score) == value, weight)
        correct = self.correct(theta)
        return F.when(self.gpcm, picked / total).otherwise(F.when(_column(score) == 1, correct).otherwise(1 - correct))

    def log_probability(self, theta, score="score") -> Column:
        found = self.score_probability(theta, score)
        return F.when(found.isNotNull(), F.ln(F.greatest(found, F.lit(PROBABILITY_FLOOR))))

    def _moment(self, theta, power: int) -> Column:
        values = self.probabilities(theta)
        return sum(
            (F.coalesce(value, F.lit(0.0)) * score**power for score, value in enumerate(values) if score), F.lit(0.0)
        )

    def expected_score(self, theta) -> Column:
        return self._moment(theta, 1)

    def information(self, theta) -> Column:
        """Fisher information."""
        scale = SCALING * self.slope * SCALING * self.slope
        mean = self._moment(theta, 1)
        logistic, correct = self.logistic(theta), self.correct(theta)
        return F.when(self.gpcm, scale * (self._moment(theta, 2) - mean * mean)).otherwise(
            scale * (1 - self.guessing) * logistic * logistic * (1 - logistic) / correct
        )

    def entropy_terms(self, theta) -> tuple[Column, Column]:
        """E[ln P] and Var[ln P] of the item's score at ``theta``, for the person-fit statistic."""
        values = [F.coalesce(value, F.lit(0.0)) for value in self.probabilities(theta)]
        logs = [F.ln(F.greatest(value, F.lit(PROBABILITY_FLOOR))) for value in values]
        mean = sum((value * log for value, log in zip(values[1:], logs[1:])), values[0] * logs[0])
        square = sum((value * log * log for value, log in zip(values[1:], logs[1:])), values[0] * logs[0] * logs[0])
        return mean, square - mean * mean


def points(model: Column, steps: list[Column]) -> Column:
    """Points in the scaling: the number of non-null steps of a GPCM item, else 1."""
    present = sum((F.when(step.isNotNull(), 1).otherwise(0) for step in steps[1:]), F.when(steps[0].isNotNull(), 1).otherwise(0))
    return F.when(model == "GPCM", present).otherwise(F.lit(1))
