"""Bootstrap intervals of a share of points, resampling items.

``poisson``, the default: every item gets a Poisson(1) weight per replicate from a hash of its key. A task adds the weighted
points of its items to a vector of replicate sums per group, and vectors add up over tasks, so groups may have any size and
no group is ever in one place. ``exact`` is for groups whose items fit one task, as those of a test: every replicate draws as many items as there are, with replacement, by an
integer hash of (replicate, draw). Neither depends on partitions or retries, and the two agree as the number of items grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thetaloom.session import task_count

REPLICATES = 2000
SLICES = 16
HELD = 500
"""Groups whose vectors a task holds before it hands them on."""
DRAWN = 16
"""Items whose weights are drawn at once: they stay in a core's cache."""
PRIME = 2_147_483_647


def _mix(values: np.ndarray) -> np.ndarray:
    """Two rounds of a permutation polynomial of degree 5 modulo a prime."""
    h = values % PRIME
    for multiplier, shift in ((48_271, 11), (69_621, 13)):
        h = (h * multiplier + shift) % PRIME
        square = h * h % PRIME
        h = square * square % PRIME * h % PRIME
    return h


def _resampled(points: np.ndarray, top: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The share of points in each of the numbered replicates."""
    n, shares = len(points), np.empty(len(replicates))
    step = max(1, 250_000 // n)
    for begin in range(0, len(replicates), step):
        r = replicates[begin : begin + step]
        picks = _mix(r[:, None] * n + np.arange(n, dtype=np.int64)[None, :]) * n // PRIME
        shares[begin : begin + step] = 100 * points[picks].sum(axis=1) / top[picks].sum(axis=1)
    return shares


def _steps() -> list[int]:
    """The least numbers whose share of the prime reaches each step of the Poisson(1) distribution."""
    found, term, total = [], np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 12):
        near = np.arange(int(total * PRIME) - 3, int(total * PRIME) + 4)
        found.append(int(near[np.searchsorted(near / PRIME, total)]))
        term /= k
        total += term
    return found


STEPS = _steps()


def _weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """The Poisson(1) weight of each item (a row, from its hash below 2^28) in each replicate: how many steps lie at or below
    ``_mix(hash * 65,537 + replicate) / PRIME``. As 2^31 is 1 modulo the prime, a number's upper bits are added to its lower ones."""
    h = hashes.astype(np.uint64)[:, None] * np.uint64(65_537) + np.arange(replicates, dtype=np.uint64)
    upper, square = np.empty_like(h), np.empty_like(h)

    def fold(values: np.ndarray) -> None:
        np.right_shift(values, np.uint64(31), out=upper)
        np.bitwise_and(values, np.uint64(PRIME), out=values)
        np.add(values, upper, out=values)

    fold(h)
    for multiplier, shift in ((48_271, 11), (69_621, 13)):
        h *= np.uint64(multiplier)
        h += np.uint64(shift)
        fold(h)
        np.multiply(h, h, out=square)
        fold(square)
        fold(square)
        np.multiply(square, square, out=square)
        fold(square)
        h *= square
        fold(h)
        fold(h)
    last = h.astype(np.uint32)
    np.subtract(last, np.uint32(PRIME), out=last, where=last >= PRIME)
    weights = np.zeros(last.shape, np.int8)
    for step in STEPS:
        weights += (last >= step).view(np.int8)
    return weights


def bootstrap_interval(
    df: DataFrame, groups: list[str], item: str, points: str, max_points: str, replicates: int = REPLICATES, method: str = "poisson"
) -> DataFrame:
    """``ci_low`` and ``ci_high`` of 100 * sum(points) / sum(max_points) per group. For a paired comparison ``points`` is
    the difference of two conditions' points on each item."""
    rows = df.select(*groups, F.col(item).cast("string").alias("_item"), F.col(points).cast("double").alias("_points"), F.col(max_points).cast("double").alias("_top"))
    if method not in ("exact", "poisson"):
        raise ValueError(f"No method {method}")
    fields = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in groups)

    def exact(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_item", kind="stable")
        first = int(frame["_slice"].iloc[0])
        r = np.arange(first, replicates, slices, dtype=np.int64)
        shares = _resampled(frame["_points"].to_numpy(), frame["_top"].to_numpy(), r)
        return pd.DataFrame({**{name: [frame[name].iloc[0]] * len(r) for name in groups}, "_r": r, "_share": shares})

    if method == "exact":
        # Every group is copied to a few slices of the replicates, so that few large groups still use all tasks.
        slices = min(SLICES, replicates)
        copies = rows.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        spread = copies.repartition(task_count(df.sparkSession), *groups, "_slice")
        return _bounds(spread.groupBy(*groups, "_slice").applyInPandas(exact, f"{fields}, _r bigint, _share double"), groups)

    kinds = [to_arrow_type(rows.schema[name].dataType) for name in groups]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        r = np.arange(replicates, dtype=np.int64)

        def handed() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                names = [pa.array([value], kind).take(pa.array(np.zeros(replicates, np.int32))) for value, kind in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(r), pa.array(total[0]), pa.array(total[1])], names=[*groups, "_r", "_points", "_top"])
            sums.clear()

        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch[name].to_pylist() for name in groups), strict=True))
            number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            owner, names = np.array([number[key] for key in keys]), list(number)
            points, top = (batch[name].to_numpy(zero_copy_only=False) for name in ("_points", "_top"))
            # An item's rows stand together, and its weights are the same for all of them.
            drawn, item = np.unique(batch["_hash"].to_numpy(), return_inverse=True)
            order = np.argsort(item, kind="stable")
            edges = np.searchsorted(item[order], np.arange(0, len(drawn) + DRAWN, DRAWN))
            for begin, a, b in zip(range(0, len(drawn), DRAWN), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = order[a:b]
                here, line = np.unique(owner[mine], return_inverse=True)
                n = len(drawn[begin : begin + DRAWN])
                at = line * n + item[mine] - begin
                shares = np.concatenate([np.bincount(at, weights=values[mine], minlength=len(here) * n).reshape(-1, n) for values in (points, top)])
                added = shares @ _weights(drawn[begin : begin + DRAWN], replicates).astype(float)
                for i, group in enumerate(here.tolist()):
                    total = sums.setdefault(names[group], np.zeros((2, replicates)))
                    total[0] += added[i]
                    total[1] += added[len(here) + i]
                if len(sums) > HELD:
                    yield from handed()
        yield from handed()

    # Items of a group may stand together in few partitions, and the weights are the work.
    number = F.conv(F.substring(F.md5("_item"), 1, 7), 16, 10).cast("bigint")
    counted = [F.when(F.col("_item").isNull(), 0.0).otherwise(F.col(name)).alias(name) for name in ("_points", "_top")]  # a missing item has no weight
    hashed = rows.select(*groups, *counted, F.coalesce(number, F.lit(0)).alias("_hash"))
    hashed = hashed.repartition(task_count(df.sparkSession), "_hash").sortWithinPartitions("_hash")
    sums = hashed.mapInArrow(partial, f"{fields}, _r bigint, _points double, _top double")
    return _bounds(sums.groupBy(*groups, "_r").agg(F.try_divide(100 * F.sum("_points"), F.sum("_top")).alias("_share")), groups)


def _bounds(shares: DataFrame, groups: list[str]) -> DataFrame:
    bounds = F.percentile("_share", F.array(F.lit(0.025), F.lit(0.975)))
    return shares.groupBy(*groups).agg(bounds.alias("_q")).select(*groups, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))
