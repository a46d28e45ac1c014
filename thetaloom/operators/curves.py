"""Sums of ln P over the items of a group, at every ability of a grid.

Nothing of the size items x grid is ever a row: each task adds up its items' curves as arrays, by group and score, and
hands over one row per group and score. Tasks' sums are added after that. A task holds the curves of a bounded number of
groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thetaloom.functions.irt import MAX_STEPS, PROBABILITY_FLOOR, SCALING, THETA_MAX, THETA_MIN, THETA_STEP
from thetaloom.operators.ability import _starts
from thetaloom.session import spread

ROWS = 64
"""Items whose curves are worked on at once: they stay in a core's cache."""
GROUPS = 256
"""Groups whose sums a task holds at once."""
_NUMBERS = ["slope", "location", "guessing", *(f"step{k}" for k in range(1, MAX_STEPS + 1))]


def _curves(columns: dict[str, np.ndarray], missing: dict[str, np.ndarray], theta: np.ndarray) -> np.ndarray:
    """ln P of scores 0, 1, ... of items at ``theta``, shaped (score, item, ability). A probability that is missing, such as
    that of a score above the item's points, counts as the floor."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        factor, apart = SCALING * columns["slope"][:, None], theta[None, :] - columns["location"][:, None]
        unknown = missing["slope"] | missing["location"]
        out = np.full((MAX_STEPS + 1, *apart.shape), PROBABILITY_FLOOR)
        guessing = columns["guessing"][:, None]
        out[1] = guessing + (1 - guessing) * (1 / (1 + np.exp(-factor * apart)))
        out[0] = 1 - out[1]
        out[:2, unknown] = PROBABILITY_FLOOR
        gpcm = np.flatnonzero(columns["gpcm"])
        if len(gpcm):
            terms, absent = [np.zeros((len(gpcm), len(theta)))], [np.zeros(len(gpcm), bool)]
            for k in range(1, MAX_STEPS + 1):
                terms.append(terms[-1] + factor[gpcm] * (apart[gpcm] + columns[f"step{k}"][gpcm, None]))
                absent.append(absent[-1] | unknown[gpcm] | missing[f"step{k}"][gpcm])
            absent = np.stack(absent)
            terms = np.where(absent[:, :, None], -np.inf, np.stack(terms))
            weights = np.exp(terms - terms.max(axis=0))
            out[:, gpcm] = np.where(absent[:, :, None], PROBABILITY_FLOOR, weights / weights.sum(axis=0))
        np.maximum(out, PROBABILITY_FLOOR, out=out)
        return np.log(out, out=out)


def _added(keys: list[str], kinds: list[pa.DataType], theta: np.ndarray):
    """Batches of items to one row per group of ``keys`` and score: the sums of ln P at ``theta``, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([(key, "ascending") for key in keys]).combine_chunks()
            if not len(table):
                continue
            starts = _starts(table, keys)
            names = list(zip(*(table[key].take(pa.array(starts)).to_pylist() for key in keys), strict=True))
            owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
            missing = {name: table[name].is_null().to_numpy() for name in _NUMBERS}
            columns = {name: table[name].fill_null(0.0).to_numpy() for name in _NUMBERS}
            columns["gpcm"] = table["gpcm"].to_numpy()
            points = table["scaled_points"].to_numpy()
            for low in range(0, len(table), ROWS):
                part = slice(low, low + ROWS)
                curves = _curves({k: v[part] for k, v in columns.items()}, {k: v[part] for k, v in missing.items()}, theta)
                told = np.arange(MAX_STEPS + 1)[:, None] <= points[part]
                curves[~told] = 0.0
                groups = owner[part]
                first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
                sums, items = np.add.reduceat(curves, first, axis=1), np.add.reduceat(told.astype(np.int64), first, axis=1)
                for at, group in enumerate(groups[first].tolist()):
                    name = names[group]
                    if name not in held:
                        if len(held) >= GROUPS:
                            yield emit(held)
                            held = {}
                        held[name] = np.zeros((MAX_STEPS + 1, len(theta))), np.zeros(MAX_STEPS + 1, np.int64)
                    held[name][0][:] += sums[:, at]
                    held[name][1][:] += items[:, at]
        if held:
            yield emit(held)

    def emit(held: dict) -> pa.RecordBatch:
        rows = [(name, score, sums[score], items[score]) for name, (sums, items) in held.items() for score in np.flatnonzero(items).tolist()]
        groups = [pa.array([row[0][i] for row in rows], kind) for i, kind in enumerate(kinds)]
        arrays = [*groups, pa.array([row[1] for row in rows], pa.int32()), pa.array([row[2] for row in rows], pa.list_(pa.float64())), pa.array([row[3] for row in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "score", "totals", "items"])

    return run


def log_probability_totals(items: DataFrame, keys: list[str], step: float = THETA_STEP) -> DataFrame:
    """``keys``, score, the place ``g`` in the grid of abilities, the sum of ln P (``total``) over the items that have such a
    score, and their number (``items``). ``items`` has the columns of an item model and ``scaled_points``."""
    fields = [items.schema[key] for key in keys]
    rows = spread(items.where("scaled_points >= 0").select(
        *keys, F.coalesce(F.col("irt_model") == "GPCM", F.lit(False)).alias("gpcm"), F.col("scaled_points").cast("int"), *[F.col(name).cast("double") for name in _NUMBERS]
    ))
    schema = ", ".join([*(f"`{field.name}` {field.dataType.simpleString()}" for field in fields), "score int, totals array<double>, items bigint"])
    theta = THETA_MIN + step * np.arange(int(round((THETA_MAX - THETA_MIN) / step)) + 1)
    added = rows.mapInArrow(_added(keys, [to_arrow_type(field.dataType) for field in fields], theta), schema)
    points = added.select(*keys, "score", "items", F.posexplode("totals").alias("g", "total"))
    return points.groupBy(*keys, "score", "g").agg(F.sum("total").alias("total"), F.sum("items").alias("items"))
