"""Exact ranks, places and quantiles of groups of any size, in one form for every size.

Rows are dealt to tasks by ranges of (group, value), so every task has about as many, whatever the values are and however
large a group is. The rows of a group that lie in earlier ranges are a small sum per group and range; the rest of a place is
counted within the range. The ranges are written with the rows, since a range drawn anew could differ. Equal values are
combined first where only their number matters. Values are of any type that sorts; a NULL group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.operators.joins import same_keys
from thetaloom.session import task_count, written


def _ranges(df: DataFrame, groups: list[str], order: list[str], size: Column) -> DataFrame:
    """``df`` with its range (``_part``), the rows of the group before the range (``_before``) and the group's total."""
    placed = written(df.repartitionByRange(task_count(df.sparkSession), *groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*groups, "_part").agg(size.alias("_size"))
    group = Window.partitionBy(*groups)
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*groups, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(group).alias("_total"))
    return same_keys(placed, offsets, [*groups, "_part"])


def _values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The distinct values of each group with their count (``_n``) and the number of rows before them (``_start``)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranged = _ranges(counts, groups, [value], F.sum("_n"))
    return ranged.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def average_ranks(df: DataFrame, groups: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with the rank of each value column in its group under the given name, from 1, tied values sharing their
    mean rank; NULL has none."""
    result = df
    for value, out in values.items():
        ranks = _values(df, groups, value).select(*groups, value, (F.col("_start") + (F.col("_n") + 1) / 2).alias(out))
        result = same_keys(result, ranks, [*groups, value], "left")
    return result.select(*df.columns, *values.values())


def unique_index(df: DataFrame, groups: list[str], value: str, key: str, out: str) -> DataFrame:
    """``df`` with the 0-based place of each row in its group by ``value``, tied values in the order of ``key``."""
    order = [value] if value == key else [value, key]
    local = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    return _ranges(df, groups, order, F.count("*")).withColumn(out, F.col("_before") + local - 1).select(*df.columns, out)


def quantiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per group with the named quantiles of ``value``, linearly interpolated between neighbours."""
    found = _values(df.select(*groups, value), groups, value)

    def index(probability: float, up: bool) -> Column:
        position = F.lit(probability) * (F.col("_total") - 1)
        return F.ceil(position) if up else F.floor(position)

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_start")) & (place < F.col("_start") + F.col("_n")), F.col(value)))

    result = []
    for name, p in probabilities.items():
        low, high = at(index(p, False)), at(index(p, True))
        share = F.max(F.lit(p) * (F.col("_total") - 1) - index(p, False))
        result.append((low + share * (high - low)).alias(name))
    return found.groupBy(*groups).agg(*result)
