"""Connected components of a table of links, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint, a != b) to (id, component): the smallest id of each connected set. Ids without links are not
    in the result.

    Each round is two steps. Large star: every id hands its larger neighbours to its smallest neighbour. Small star: every
    id hands its smaller neighbours to the smallest of them. Links only ever move towards smaller ids, components stay
    joined, and the number of rounds grows with the logarithm of the longest path. It ends when a round changes nothing.
    A hub costs no more than its links: minima are aggregated before the join, and a skewed join is split."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        now = written(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select(F.col("b"), F.col("b")).distinct())


def _state(links: DataFrame) -> tuple:
    """The number of links and two sums over them; equal for equal sets, and different, but for chance, for others."""
    code = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(code, 20)), F.bit_xor(code)).first())
