"""Joins in which a missing key equals a missing key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the further columns of ``right`` where all ``keys`` agree, NULL with NULL."""
    names = {key: f"_right_{key}" for key in keys}
    renamed = right.select(*[F.col(key).alias(name) for key, name in names.items()], *[c for c in right.columns if c not in names])
    matched = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
    return left.join(renamed, matched, how).drop(*names.values())
