"""Distribution functions Spark lacks, as ``Column`` expressions on already aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from thetaloom.functions.binding import bound

SERIES_LIMIT = 1000
"""Up to this many degrees of freedom the t tail is the exact finite series; above it a normal expansion is exact to
1e-12 and needs no loop."""
QUANTILE_TABLE = 60
Z975 = 1.959963984540054


def _polynomial(coefficients: list[float], x: Column) -> Column:
    result = F.lit(coefficients[0])
    for value in coefficients[1:]:
        result = result * x + value
    return result


# Hart's (1968) rational approximation of the normal tail in double precision, as given by West (2005).
HART_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, accurate to about 1e-15."""
    return bound(x, _normal_cdf)


def _normal_cdf(x: Column) -> Column:
    size = F.abs(x)
    density = F.exp(-size * size / 2)
    near = density * _polynomial(HART_TOP, size) / _polynomial(HART_BOTTOM, size)
    fraction = size + 0.65
    for step in (4, 3, 2, 1):
        fraction = size + step / fraction
    far = density / fraction / 2.506628274631
    tail = F.when(size > 37, F.lit(0.0)).when(size < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _series_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for integer df (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    return bound(F.atan(F.abs(t) / F.sqrt(df)), lambda angle: _series(angle, df))


def _series(angle: Column, df: Column) -> Column:
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    # Terms after the first: even df multiply by (2j - 1) / 2j, odd df by 2j / (2j + 1), each times cos^2.
    count = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), (cosine * cosine).alias("square"))

    def step(state, j):
        top = F.when(odd, 2.0 * j).otherwise(2.0 * j - 1)
        term = state["term"] * state["square"] * top / (top + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"), state["square"].alias("square"))

    terms = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, start, step, lambda state: state["total"])
    inside = (
        F.when(df == 1, 2 * angle / math.pi)
        .when(odd, 2 / math.pi * (angle + sine * cosine * total))
        .otherwise(sine * total)
    )
    return 1 - inside


def _normal_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for many degrees of freedom (Hill 1970)."""
    a = df - 0.5
    b = 48 * a * a

    def corrected(z: Column) -> Column:
        z2 = z * z
        return z + (z2 + 3) * z / b - ((4 * z2 + 33) * z2 * z2 + 240 * z2 + 855) * z / (10 * b * (b + 0.8 * z2 * z2 + 100))

    return 2 * normal_cdf(-bound(F.sqrt(a * F.log1p(t * t / df)), corrected))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic with an integer number of degrees of freedom; NULL if either is NULL."""

    def tail(both: Column) -> Column:
        t, df = both["t"], both["df"]
        return F.when(df <= SERIES_LIMIT, F.greatest(_series_tail(t, df), F.lit(0.0))).otherwise(_normal_tail(t, df))

    return F.when(t.isNotNull(), bound(F.struct(t.alias("t"), df.cast("double").alias("df")), tail))


def _tail(t: float, df: int) -> float:
    angle = math.atan(t / math.sqrt(df))
    sine, cosine = math.sin(angle), math.cos(angle)
    term = total = 1.0
    for j in range(1, (df - 3) // 2 + 1 if df % 2 else (df - 2) // 2 + 1):
        term *= cosine**2 * (2 * j / (2 * j + 1) if df % 2 else (2 * j - 1) / (2 * j))
        total += term
    if df == 1:
        return 1 - 2 * angle / math.pi
    return 1 - (2 / math.pi * (angle + sine * cosine * total) if df % 2 else sine * total)


def _quantile(df: int) -> float:
    low, high = 1.0, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(middle, df) > 0.05 else (low, middle)
    return (low + high) / 2


def t_quantile_975(df: Column) -> Column:
    """The 97.5% quantile of Student's t: a small table, then the expansion of Abramowitz and Stegun 26.7.5."""
    table = F.array(*[F.lit(_quantile(value)) for value in range(1, QUANTILE_TABLE + 1)])
    n, z = df.cast("double"), Z975
    expansion = (
        z
        + (z**3 + z) / 4 / n
        + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n * n)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (n * n * n)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / (n * n * n * n)
    )
    small = F.element_at(table, F.when((df >= 1) & (df <= QUANTILE_TABLE), df.cast("int")).otherwise(F.lit(1)))
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= QUANTILE_TABLE, small).otherwise(expansion)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation of the complete pairs; NULL for fewer than 3 pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    cx, cy = F.when(both, x), F.when(both, y)
    varied = (F.count(cx) >= 3) & (F.min(cx) < F.max(cx)) & (F.min(cy) < F.max(cy))
    return F.when(varied, F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(cx) * F.stddev_pop(cy)))
