"""Ability estimates of response patterns: EAP and maximum likelihood on a grid of theta.

A pattern is the set of responses of one group (such as a respondent on a calibration). Three equivalent forms:

- ``estimate_theta`` shuffles the compact response rows once by group, sorts them, and lets each task stream through its
  groups with vectorised arithmetic. Nothing of the size of (responses x grid) is ever shuffled or stored.
- Groups that are too large for one task are added up: each task sums the curves of its rows of a group as an array, and hands
  over one row per group; a second pass does the same around the maximum. So a group of any size is spread over all tasks.
- ``estimate_theta_relational`` states the same sums as a (response x grid) aggregation in built-in functions. It is the
  definition that the other forms are tested against.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.functions.irt import PROBABILITY_FLOOR, SCALING, THETA_MAX, THETA_MIN, THETA_STEP, ItemModel
from thetaloom.operators.joins import same_keys
from thetaloom.session import spread, task_count, written

LARGE_GROUP = 200_000
"""Groups with more responses than this are added up over all tasks."""
HELD = 256
"""Groups whose sums a task holds at once."""
FINE_HALF_WIDTH, FINE_STEP = 0.02, 1e-4
ROWS_PER_BLOCK = 64
REPEATED_ROWS = 4096
ROWS_PER_LOGARITHM, FACTOR, MODERATE_REACH = 4, 32, 160.0
NODES = 36.0

ESTIMATE_FIELDS = (
    "items bigint, points bigint, max_points bigint, theta_eap double, theta_eap_se double, theta_mle double, "
    "theta_mle_se double, mle_note string"
)
_PARAMETERS = ["slope", "location", "guessing", "step1", "step2", "step3"]


def grid(step: float = THETA_STEP) -> np.ndarray:
    return np.linspace(THETA_MIN, THETA_MAX, int(round((THETA_MAX - THETA_MIN) / step)) + 1)


def _prepared(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Scored responses with every parameter column present."""
    names = responses.columns
    parameters = [(F.col(p) if p in names else F.lit(None)).cast("double").alias(p) for p in _PARAMETERS]
    return responses.filter(F.col("score").isNotNull()).select(
        *keys, "irt_model", F.col("scaled_points").cast("int"), F.col("score").cast("int"), *parameters
    )


# --- streaming form -------------------------------------------------------------------------------------------------


class _Block:
    """The parameters of consecutive responses, and their score probabilities at given abilities."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.gpcm = columns["irt_model"] == "GPCM"
        self.score, self.points = columns["score"].astype(np.int64), columns["scaled_points"].astype(np.int64)
        self.slope, self.location = columns["slope"], columns["location"]
        self.guessing = np.nan_to_num(columns["guessing"])
        self.steps = np.stack([columns["step1"], columns["step2"], columns["step3"]], axis=1)

    def __len__(self):
        return len(self.score)

    def probabilities(self, theta: np.ndarray, rows: slice) -> list[np.ndarray]:
        """P(score = k), k = 0, 1, ..., of the rows at ``theta`` (one row of abilities, or one per response)."""
        slope, location = self.slope[rows, None], self.location[rows, None]
        guessing, gpcm = self.guessing[rows, None], self.gpcm[rows]
        correct = guessing + (1 - guessing) / (1 + np.exp(-SCALING * slope * (theta - location)))
        result = [1 - correct, correct]
        if gpcm.any():
            picked = np.flatnonzero(gpcm)
            at = theta if theta.shape[0] == 1 else theta[picked]
            steps = self.steps[rows][picked]
            top = int((~np.isnan(steps)).sum(axis=1).max())
            terms = [np.zeros((len(picked), at.shape[1]))]
            for k in range(top):
                terms.append(terms[-1] + SCALING * slope[picked] * (at - location[picked] + steps[:, k, None]))
            cumulative = np.stack(terms)
            weights = np.exp(cumulative - np.nanmax(cumulative, axis=0))
            weights = np.nan_to_num(weights) / np.nansum(weights, axis=0)
            while len(result) < top + 1:
                result.append(np.zeros_like(correct))
            for k in range(top + 1):
                result[k][picked] = weights[k]
        return result

    def log_likelihood(self, theta: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        """ln P of the observed scores of the rows, in place in one matrix that stays in the processor's cache."""
        slope, location, score, gpcm = self.slope[rows], self.location[rows], self.score[rows], self.gpcm[rows]
        guessing = self.guessing[rows, None]
        sign, offset = np.where(score == 1, 1.0, -1.0)[:, None], np.where(score == 1, 0.0, 1.0)[:, None]
        out = theta - location[:, None]
        out *= (-SCALING * slope)[:, None]
        np.exp(out, out=out)
        out += 1
        np.reciprocal(out, out=out)
        out *= 1 - guessing
        out += guessing
        out *= sign
        out += offset
        np.maximum(out, PROBABILITY_FLOOR, out=out)
        np.log(out, out=out)
        if gpcm.any():
            picked = np.flatnonzero(gpcm)
            at = (theta if theta.shape[0] == 1 else theta[picked]) - location[picked, None]
            steps = self.steps[rows][picked]
            total = np.zeros((len(picked), at.shape[1]))
            terms = [total]
            for k in range(int((~np.isnan(steps)).sum(axis=1).max())):
                total = total + (SCALING * slope[picked])[:, None] * (at + steps[:, k, None])
                terms.append(np.where(np.isnan(steps[:, k, None]), -np.inf, total))
            cumulative = np.stack(terms)
            top = cumulative.max(axis=0)
            spread = np.log(np.exp(cumulative - top).sum(axis=0))
            observed = np.take_along_axis(cumulative, score[picked][None, :, None], axis=0)[0]
            out[picked] = np.maximum(observed - top - spread, np.log(PROBABILITY_FLOOR))
        return out

    def moderate(self) -> bool:
        """Whether no probability on the grid comes near the floor."""
        reach = SCALING * np.abs(self.slope) * (THETA_MAX + np.abs(self.location))
        reach = np.where(self.gpcm, self.points * (reach + SCALING * np.abs(self.slope) * np.abs(np.nan_to_num(self.steps)).max(axis=1)), reach)
        return bool(reach.max() < MODERATE_REACH and self.guessing.max() < 0.99)

    def observed_on_grid(self, step: float, count: int, rows: slice) -> np.ndarray:
        """P(observed score) of the rows on the grid. On an even grid exp(-1.7 a (theta - b)) is the product of a coarse and
        a fine factor, so a few exponentials per row give all points."""
        k, score, gpcm = SCALING * self.slope[rows], self.score[rows], self.gpcm[rows]
        low = THETA_MIN + step * FACTOR * np.arange(-(-count // FACTOR))
        coarse = np.exp(-k[:, None] * (low[None, :] - self.location[rows, None]))
        fine = np.exp(-k[:, None] * (step * np.arange(FACTOR))[None, :])
        odds = (coarse[:, :, None] * fine[:, None, :]).reshape(len(k), -1)[:, :count]
        one = (score == 1).astype(float)
        rest = 1 - self.guessing[rows]
        inverse = 1 / (1 + odds)
        out = (rest * (1 - one))[:, None] * odds
        out += (rest * one)[:, None]
        out *= inverse
        out += (self.guessing[rows] * one)[:, None]
        if gpcm.any():
            picked = np.flatnonzero(gpcm)
            powers, steps, top = odds[picked], self.steps[rows][picked], self.points[rows][picked]
            weights = np.zeros((int(top.max()) + 1, *powers.shape))
            total = np.zeros(len(picked))
            for j in range(len(weights)):  # P(j) is proportional to exp(1.7 a (d_1 + ... + d_j)) odds^(m - j)
                if j:
                    total = total + k[picked] * np.nan_to_num(steps[:, j - 1])
                weights[j] = np.where((j <= top)[:, None], np.exp(total)[:, None] * powers ** np.maximum(top - j, 0)[:, None], 0.0)
            out[picked] = np.take_along_axis(weights, score[picked][None, :, None], axis=0)[0] / weights.sum(axis=0)
        return out

    def observed_at(self, theta: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """P(observed score) of dichotomous rows at ``theta``, to its full precision where it is small."""
        one, rest = (self.score[rows] == 1)[:, None], 1 - self.guessing[rows, None]
        odds = theta - self.location[rows, None]
        odds *= -SCALING * self.slope[rows, None]
        np.exp(odds, out=odds)
        out = rest * np.where(one, 1.0, odds)
        odds += 1
        out /= odds
        out += np.where(one, 1 - rest, 0.0)
        return out

    def information(self, theta: np.ndarray, rows: slice) -> np.ndarray:
        slope, location = self.slope[rows, None], self.location[rows, None]
        guessing = self.guessing[rows, None]
        logistic = 1 / (1 + np.exp(-SCALING * slope * (theta - location)))
        correct = guessing + (1 - guessing) * logistic
        dichotomous = (1 - guessing) * logistic**2 * (1 - logistic) / correct
        values = self.probabilities(theta, rows)
        mean = sum(k * value for k, value in enumerate(values))
        variance = sum(k * k * value for k, value in enumerate(values)) - mean**2
        return (SCALING * slope) ** 2 * np.where(self.gpcm[rows, None], variance, dichotomous)


def _sums_by_group(function, theta: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """Sums over each group's rows of ``function(theta, rows)``, a bounded number of rows at a time. ``theta`` has one
    row for all groups, or one row per group."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))
    sums = np.zeros((len(starts), theta.shape[1]))
    for begin in range(0, rows, ROWS_PER_BLOCK):
        block = slice(begin, min(begin + ROWS_PER_BLOCK, rows))
        groups = owner[block]
        values = function(theta if theta.shape[0] == 1 else theta[groups], block)
        first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        sums[groups[first]] += np.add.reduceat(values, first, axis=0)
    return sums


def _grid_likelihood(block: _Block, step: float, starts: np.ndarray) -> np.ndarray:
    """The log-likelihood of each group on the grid. Where few distinct (item, score) pairs make up the rows, each pair's
    curve is computed once and the rows only add it up."""
    theta = grid(step)
    columns = np.column_stack([block.gpcm, block.score, block.slope, block.location, block.guessing, np.nan_to_num(block.steps, nan=99.0)])
    _, first, place = np.unique(columns, axis=0, return_index=True, return_inverse=True)
    if len(first) <= min(REPEATED_ROWS, len(block) // 2):
        curves = np.concatenate([block.log_likelihood(theta[None, :], first[i : i + ROWS_PER_BLOCK]) for i in range(0, len(first), ROWS_PER_BLOCK)])
        place = place.ravel()
        return _sums_by_group(lambda _, rows: curves[place[rows]], theta[None, :], starts, len(block))
    if block.moderate():
        found = _interpolated(block, step, starts)
        return _products_by_group(block, step, len(theta), starts) if found is None else found
    return _sums_by_group(block.log_likelihood, theta[None, :], starts, len(block))


@lru_cache(maxsize=8)
def _from_nodes(count: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev nodes of the range of the grid, and the matrix that takes values there to the grid (barycentric form)."""
    angle = np.pi * (2 * np.arange(count) + 1) / (2 * count)
    nodes = (THETA_MIN + THETA_MAX) / 2 + (THETA_MAX - THETA_MIN) / 2 * np.cos(angle)
    apart = grid(step)[:, None] - nodes
    weight = (-1.0) ** np.arange(count) * np.sin(angle) / np.where(apart == 0, 1.0, apart)
    weight = np.where((apart == 0).any(axis=1, keepdims=True), apart == 0, weight)
    return nodes, weight / weight.sum(axis=1, keepdims=True)


def _interpolated(block: _Block, step: float, starts: np.ndarray) -> np.ndarray | None:
    """The same sums from their values at fewer abilities. ln P of an item has no singular point nearer to the grid than
    pi / (1.7 |a|), or that over the steps of a GPCM item, so the polynomial through ``count`` Chebyshev nodes is off by
    exp(-NODES) of the values. None where that takes too many nodes, or parameters are not those of the models."""
    steps = (~np.isnan(block.steps)).sum(axis=1)
    right = np.where(block.gpcm, (steps == block.points) & (block.score <= block.points), (block.guessing >= 0) & (block.guessing < 1))
    if not right.all():
        return None
    places = len(grid(step))
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(block))))
    kinds = []
    for mine, degree in ((np.flatnonzero(~block.gpcm), 1), (np.flatnonzero(block.gpcm), int(steps.max(initial=1)) or 1)):
        if len(mine):
            near = np.pi / (degree * SCALING * max(np.abs(block.slope[mine]).max(), 1e-3)) / ((THETA_MAX - THETA_MIN) / 2)
            count = int(-(-NODES / np.arcsinh(near) // 32)) * 32
            if 2 * count > places:
                return None
            kinds.append((mine, count))
    sums = np.zeros((len(starts), places))
    for mine, count in kinds:
        nodes, matrix = _from_nodes(count, step)
        firsts = np.flatnonzero(np.append(True, owner[mine][1:] != owner[mine][:-1]))
        at_nodes = np.zeros((len(firsts), count))
        place = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(mine))))
        for begin in range(0, len(mine), ROWS_PER_BLOCK):
            part = mine[begin : begin + ROWS_PER_BLOCK]
            groups = place[begin : begin + ROWS_PER_BLOCK]
            first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            if block.gpcm[part[0]]:
                sums_here = np.add.reduceat(block.log_likelihood(nodes[None, :], part), first, axis=0)
            else:
                pieces = np.union1d(first, np.arange(0, len(part), ROWS_PER_LOGARITHM))
                logs = np.log(np.multiply.reduceat(block.observed_at(nodes, part), pieces, axis=0))
                sums_here = np.add.reduceat(logs, np.searchsorted(pieces, first), axis=0)
            at_nodes[groups[first]] += sums_here
        sums[owner[mine][firsts]] += at_nodes @ matrix.T
    return sums


def _products_by_group(block: _Block, step: float, count: int, starts: np.ndarray) -> np.ndarray:
    """The same sums of logarithms with one logarithm for the product of several rows of a group, which moderate
    parameters keep far from underflow."""
    rows = len(block)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))
    sums = np.zeros((len(starts), count))
    for begin in range(0, rows, ROWS_PER_BLOCK):
        part = slice(begin, min(begin + ROWS_PER_BLOCK, rows))
        groups = owner[part]
        first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        pieces = np.union1d(first, np.arange(0, len(groups), ROWS_PER_LOGARITHM))
        logs = np.log(np.multiply.reduceat(block.observed_on_grid(step, count, part), pieces, axis=0))
        sums[groups[first]] += np.add.reduceat(logs, np.searchsorted(pieces, first), axis=0)
    return sums


def _estimates(block: _Block, starts: np.ndarray, step: float) -> dict[str, np.ndarray]:
    rows, theta = len(block), grid(step)
    likelihood = _grid_likelihood(block, step, starts)
    posterior = np.exp(likelihood - likelihood.max(axis=1, keepdims=True)) * np.exp(-(theta**2) / 2)
    posterior /= posterior.sum(axis=1, keepdims=True)
    eap = posterior @ theta
    spread = np.sqrt((posterior * (theta[None, :] - eap[:, None]) ** 2).sum(axis=1))
    points, top = np.add.reduceat(block.score, starts), np.add.reduceat(block.points, starts)
    each, top_place = np.arange(len(starts)), likelihood.argmax(axis=1)
    coarse = theta[top_place]
    zero, perfect = points == 0, points == top
    beyond = ~zero & ~perfect & (np.abs(coarse) >= THETA_MAX - step / 2)
    # Second level: the best point of a fine grid around the coarse maximum, started from the vertex of the parabola
    # through the coarse points, then the vertex of the parabola through the best fine points.
    half = int(round(max(FINE_HALF_WIDTH, 2 * step) / FINE_STEP))
    inside = np.clip(top_place, 1, len(theta) - 2)
    left, middle, right = (likelihood[each, inside + i] for i in (-1, 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        start = theta[inside] + np.nan_to_num(step * (left - right) / (2 * (left - 2 * middle + right))) - coarse
    place = np.clip(np.rint(start / FINE_STEP), 2 - half, half - 2)
    while True:  # every move raises a likelihood, or keeps it and goes down, so it ends
        fine = coarse[:, None] + (place[:, None] + np.arange(-2, 3)) * FINE_STEP
        near = _sums_by_group(block.log_likelihood, fine, starts, rows)
        best = near.argmax(axis=1)
        moving = (np.abs(best - 2) == 2) & ~(zero | perfect | beyond)
        moved = np.clip(place + np.where(moving, best - 2, 0), 2 - half, half - 2)
        if (moved == place).all():
            break
        place = moved
    best = np.clip(best, 1, 3)
    left, middle, right = near[each, best - 1], near[each, best], near[each, best + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        vertex = fine[each, best] + np.nan_to_num(FINE_STEP * (left - right) / (2 * (left - 2 * middle + right)))
        information = _sums_by_group(block.information, vertex[:, None], starts, rows)[:, 0]
        error = 1 / np.sqrt(information)
    note = np.full(len(starts), None, dtype=object)
    # The reasons of an infinite estimate.
    note[beyond], note[perfect], note[zero] = "beyond ±6", "perfect score", "zero score"
    finite = note == None  # noqa: E711
    infinite = np.where(zero | (beyond & (coarse < 0)), -np.inf, np.inf)
    return {
        "items": np.diff(np.append(starts, rows)),
        "points": points,
        "max_points": top,
        "theta_eap": eap,
        "theta_eap_se": spread,
        "theta_mle": np.where(finite, vertex, infinite),
        "theta_mle_se": pa.array(error, mask=~finite.astype(bool)),
        "mle_note": note,
    }


def _streaming(keys: list[str], key_types: list[pa.DataType], step: float):
    """A function over the sorted batches of a partition that yields one row per group. Only the rows of the group
    still open at the end of a batch are carried over to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            starts = _starts(table, keys)
            carry = table.slice(starts[-1]).combine_chunks()
            if len(starts) > 1:
                yield emit(table.slice(0, starts[-1]), starts[:-1])
        if carry is not None and len(carry):
            yield emit(carry, np.array([0]))

    def emit(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = {name: table[name].to_numpy() for name in ["irt_model", "score", "scaled_points", *_PARAMETERS]}
        columns = {k: v.astype(float) if k in _PARAMETERS else v for k, v in columns.items()}
        values = _estimates(_Block(columns), starts, step)
        names = table.select(keys).take(pa.array(starts)).combine_chunks()
        arrays = [names[key].cast(kind).combine_chunks() for key, kind in zip(keys, key_types)]
        arrays += [
            pa.array(values["items"], pa.int64()),
            pa.array(values["points"], pa.int64()),
            pa.array(values["max_points"], pa.int64()),
            pa.array(values["theta_eap"]),
            pa.array(values["theta_eap_se"]),
            pa.array(values["theta_mle"]),
            values["theta_mle_se"],
            pa.array(values["mle_note"], pa.string()),
        ]
        fields = [name.split()[0] for name in ESTIMATE_FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *fields])

    return run


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys starts in a sorted table."""
    change = np.zeros(len(table), dtype=bool)
    change[0] = True
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode("encode")  # a missing key is a key
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _estimate_cold(prepared: DataFrame, keys: list[str], step: float) -> DataFrame:
    fields = [prepared.schema[key] for key in keys]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = ", ".join([*(f"{field.name} {field.dataType.simpleString()}" for field in fields), ESTIMATE_FIELDS])
    function = _streaming(keys, [to_arrow_type(field.dataType) for field in fields], step)
    # An explicit number: the rows are compact but costly, so their size must not decide how many tasks share them.
    return prepared.repartition(task_count(prepared.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(function, schema)


# --- relational form ------------------------------------------------------------------------------------------------


def estimate_theta_relational(responses: DataFrame, keys: list[str], step: float = THETA_STEP) -> DataFrame:
    """The estimates as aggregations over (response x grid point): partial sums per (group, grid point) are combined in
    every task before the shuffle, which therefore carries at most (groups x grid points) rows per task."""
    prepared = _prepared(responses, keys)
    model = ItemModel(steps=3)
    last = int(round((THETA_MAX - THETA_MIN) / step))
    theta = F.lit(THETA_MIN) + F.col("_g") * F.lit(step)
    sums = (
        prepared.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .groupBy(*keys, "_g")
        .agg(
            F.sum(model.log_probability(theta)).alias("_ll"),
            F.count("*").alias("items"),
            F.sum("score").alias("points"),
            F.sum("scaled_points").alias("max_points"),
        )
    )
    tops = sums.groupBy(*keys).agg(
        F.max("_ll").alias("_top"), F.max_by("_g", F.struct("_ll", -F.col("_g"))).alias("_best"),
        *[F.first(name).alias(name) for name in ("items", "points", "max_points")],
    )
    weighted = same_keys(sums.select(*keys, "_g", "_ll"), tops, keys)
    weight = F.exp(F.col("_ll") - F.col("_top") - theta * theta / 2)
    eap = weighted.groupBy(*keys).agg(
        F.first(F.lit(THETA_MIN) + F.col("_best") * F.lit(step)).alias("_coarse"),
        *[F.first(name).alias(name) for name in ("items", "points", "max_points")],
        F.sum(weight).alias("_w"),
        F.sum(weight * theta).alias("_wt"),
        F.sum(weight * theta * theta).alias("_wtt"),
    )
    mean = F.col("_wt") / F.col("_w")
    beyond = F.abs(F.col("_coarse")) >= THETA_MAX - step / 2
    note = (
        F.when(F.col("points") == 0, "zero score")
        .when(F.col("points") == F.col("max_points"), "perfect score")
        .when(beyond, "beyond ±6")
    )
    eap = eap.select(
        *keys, "items", "points", "max_points", "_coarse",
        mean.alias("theta_eap"), F.sqrt(F.col("_wtt") / F.col("_w") - mean * mean).alias("theta_eap_se"), note.alias("mle_note"),
    )
    # Second level around the coarse maximum of the groups with a finite estimate.
    half = int(round(max(FINE_HALF_WIDTH, 2 * step) / FINE_STEP))
    centers = eap.filter(F.col("mle_note").isNull()).select(*keys, "_coarse")
    at = F.col("_coarse") + F.col("_f") * F.lit(FINE_STEP)
    fine = (
        same_keys(prepared, centers, keys)
        .withColumn("_f", F.explode(F.sequence(F.lit(-half), F.lit(half))))
        .groupBy(*keys, "_coarse", "_f")
        .agg(F.sum(model.log_probability(at)).alias("_ll"))
    )
    best = fine.groupBy(*keys).agg(F.max_by("_f", F.struct("_ll", -F.col("_f"))).alias("_b"))
    best = best.withColumn("_b", F.greatest(F.least("_b", F.lit(half - 1)), F.lit(1 - half)))
    around = same_keys(fine, best, keys).filter(F.abs(F.col("_f") - F.col("_b")) <= 1)

    def likelihood(offset: int) -> Column:
        return F.max(F.when(F.col("_f") == F.col("_b") + offset, F.col("_ll")))

    bend = likelihood(-1) - 2 * likelihood(0) + likelihood(1)
    vertex = F.first(F.col("_coarse") + F.col("_b") * F.lit(FINE_STEP)) + F.coalesce(
        F.when(bend != 0, FINE_STEP * (likelihood(-1) - likelihood(1)) / (2 * bend)), F.lit(0.0)
    )
    vertices = around.groupBy(*keys).agg(vertex.alias("theta_mle"))
    information = (
        same_keys(prepared, vertices, keys)
        .groupBy(*keys, "theta_mle")
        .agg((1 / F.sqrt(F.sum(model.information("theta_mle")))).alias("theta_mle_se"))
    )
    infinite = F.when(
        (F.col("points") == 0) | ((F.col("mle_note") == "beyond ±6") & (F.col("_coarse") < 0)), F.lit(float("-inf"))
    ).otherwise(F.lit(float("inf")))
    return same_keys(eap, information, keys, "left").select(
        *keys, "items", "points", "max_points", "theta_eap", "theta_eap_se",
        F.when(F.col("mle_note").isNull(), F.col("theta_mle")).otherwise(infinite).alias("theta_mle"),
        "theta_mle_se", "mle_note",
    )


# --- large groups ---------------------------------------------------------------------------------------------------


def _added(keys: list[str], kinds: list[pa.DataType], curves):
    """Batches of rows to one row per group of ``keys``, with the sums that ``curves`` (block, first rows of the groups, table)
    gives, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([(key, "ascending") for key in keys]).combine_chunks()
            if not len(table):
                continue
            starts = _starts(table, keys)
            columns = {name: table[name].to_numpy() for name in ["irt_model", "score", "scaled_points", *_PARAMETERS]}
            block = _Block({k: v.astype(float) if k in _PARAMETERS else v for k, v in columns.items()})
            names = zip(*(table[key].take(pa.array(starts)).to_pylist() for key in keys), strict=True)
            for name, sums in zip(names, curves(block, starts, table), strict=True):
                if name not in held and len(held) >= HELD:
                    yield emit(held)
                    held = {}
                held[name] = held[name] + sums if name in held else sums
        if held:
            yield emit(held)

    def emit(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        groups = [pa.array([name[i] for name in held], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*groups, pa.array(list(held.values()), pa.list_(pa.float64()))], names=[*keys, "totals"])

    return run


def _estimate_large(prepared: DataFrame, groups: DataFrame, keys: list[str], step: float) -> DataFrame:
    """The estimates of ``groups`` (``keys``, items, points, max_points), whose rows may be in all tasks."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [prepared.schema[key] for key in keys]
    kinds = [to_arrow_type(field.dataType) for field in fields]
    named = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)
    theta, half = grid(step), int(round(max(FINE_HALF_WIDTH, 2 * step) / FINE_STEP))
    places = np.arange(-half, half + 1)
    # A response whose probability is missing, or the same at every ability for want of a parameter, is an item of its group and adds
    # nothing to the likelihood; steps after a missing one are missing.
    told = ItemModel(steps=3).log_probability(F.lit(0.0)).isNotNull() & F.col("slope").isNotNull() & F.col("location").isNotNull()
    told &= F.coalesce(F.col("irt_model") != "GPCM", F.lit(True)) | F.col("step1").isNotNull()
    rows = prepared.where(told).withColumn("scaled_points", F.coalesce("scaled_points", F.lit(0))).withColumn("step3", F.when(F.col("step2").isNotNull(), F.col("step3")))
    rows = same_keys(rows, groups.select(*keys), keys)

    def summed(frame: DataFrame, curves, finish, schema: str) -> DataFrame:
        def whole(table: pa.Table) -> pa.Table:
            total = np.sum([np.array(x) for x in table["totals"].to_pylist()], axis=0)
            return pa.table([*(table[key].slice(0, 1) for key in keys), *(pa.array([x]) for x in finish(total, table))], names=[*keys, *(x.split()[0] for x in schema.split(", "))])

        totals = frame.mapInArrow(_added(keys, kinds, curves), f"{named}, totals array<double>")
        if "_coarse" in frame.columns:
            totals = same_keys(totals, centers, keys)
        return totals.groupBy(*keys).applyInArrow(whole, f"{named}, {schema}")

    def ability(likelihood: np.ndarray, _) -> tuple[float, ...]:
        posterior = np.exp(likelihood - likelihood.max() - theta**2 / 2)
        posterior /= posterior.sum()
        eap = posterior @ theta
        return theta[likelihood.argmax()], eap, np.sqrt((posterior * (theta - eap) ** 2).sum())

    def near(block: _Block, starts: np.ndarray, table: pa.Table) -> np.ndarray:
        coarse = table["_coarse"].to_numpy()[starts]
        return _sums_by_group(block.log_likelihood, coarse[:, None] + places * FINE_STEP, starts, len(block))

    def vertex(likelihood: np.ndarray, table: pa.Table) -> tuple[float]:
        best = min(max(int(likelihood.argmax()), 1), len(places) - 2)
        left, middle, right = likelihood[best - 1 : best + 2]
        bend = left - 2 * middle + right
        return (table["_coarse"][0].as_py() + places[best] * FINE_STEP + (FINE_STEP * (left - right) / (2 * bend) if bend else 0.0),)

    first = summed(rows, lambda block, starts, _: _grid_likelihood(block, step, starts), ability, "_coarse double, theta_eap double, theta_eap_se double")
    eap = same_keys(groups, written(first, "abilities"), keys)
    beyond = F.abs(F.col("_coarse")) >= THETA_MAX - step / 2
    note = F.when(F.col("points") == 0, "zero score").when(F.col("points") == F.col("max_points"), "perfect score").when(beyond, "beyond ±6")
    eap = written(eap.withColumn("mle_note", note), "abilities")
    centers = eap.where("mle_note is null").select(*keys, "_coarse")
    vertices = written(summed(same_keys(rows, centers, keys), near, vertex, "theta_mle double"), "vertices")
    information = same_keys(prepared, vertices, keys).groupBy(*keys, "theta_mle").agg((1 / F.sqrt(F.sum(ItemModel(steps=3).information("theta_mle")))).alias("theta_mle_se"))
    infinite = F.when((F.col("points") == 0) | ((F.col("mle_note") == "beyond ±6") & (F.col("_coarse") < 0)), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return same_keys(eap, information, keys, "left").select(
        *keys, "items", "points", "max_points", "theta_eap", "theta_eap_se",
        F.when(F.col("mle_note").isNull(), F.col("theta_mle")).otherwise(infinite).alias("theta_mle"), "theta_mle_se", "mle_note",
    )


# --- entry ----------------------------------------------------------------------------------------------------------


def estimate_theta(
    responses: DataFrame,
    keys: list[str],
    step: float = THETA_STEP,
    max_group_rows: int | None = None,
    large_group: int = LARGE_GROUP,
) -> DataFrame:
    """One row per group of ``keys`` with its items, points, EAP and MLE of theta, their standard errors and the reason
    of an infinite MLE.

    ``max_group_rows`` is an upper bound of a group's responses if the caller can prove one, such as the number of items
    of the largest calibration. Without a bound, or with one above ``large_group``, the groups are counted and the large
    ones are added up over all tasks.
    """
    prepared = _prepared(responses, keys)
    if max_group_rows is not None and max_group_rows <= large_group:
        return _estimate_cold(prepared, keys, step)
    # Written: the count and each pass over the large groups read it.
    prepared = written(spread(prepared), "responses")
    sizes = prepared.groupBy(*keys).agg(F.count("*").alias("items"), F.sum("score").alias("points"), F.sum("scaled_points").alias("max_points"))
    # The list of large groups has at most (responses / large_group) rows; the join strategy follows its measured size.
    large = written(sizes.filter(F.col("items") > large_group), "large")
    small = same_keys(prepared, large.select(*keys, F.lit(True).alias("_large")), keys, "left").where("_large is null").drop("_large")
    return _estimate_cold(small, keys, step).unionByName(_estimate_large(prepared, large, keys, step))
