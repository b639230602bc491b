"""Statistical column expressions.  All stay in the JVM; none divides by zero."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(*cols: Column | str) -> Column:
    """All of the columns are neither null, NaN nor infinite."""
    tests = [col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(float("inf"))) for c in cols]
    return reduce(lambda a, b: a & b, tests)


def no_nan(c: Column | str) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(col(c)), col(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def average_rank(value: Column | str, *part: str) -> Column:
    """Rank from 1 within ``part``, ties at their mean."""
    ordered = Window.partitionBy(*part).orderBy(col(value))
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(Window.partitionBy(*part, col(value))) - 1) / 2


def correlation(x: Column | str, y: Column | str, min_obs: int = 2) -> Column:
    """Pearson aggregate; null below ``min_obs`` rows or where a side is constant."""
    vx, vy = F.var_pop(col(x)), F.var_pop(col(y))
    return F.when((F.count(F.lit(1)) >= min_obs) & (vx > 0) & (vy > 0), F.covar_pop(col(x), col(y)) / F.sqrt(vx * vy))


def zscore(value: Column | str, *part: str) -> Column:
    """Population z-score within ``part``; null where fewer than two values or no spread."""
    w = Window.partitionBy(*part)
    sd = F.stddev_pop(col(value)).over(w)
    return F.when((F.count(col(value)).over(w) >= 2) & (sd > 0), (col(value) - F.avg(col(value)).over(w)) / sd)


def trailing(n: int, *part: str, order: str = "date") -> Window:
    return Window.partitionBy(*part).orderBy(order).rowsBetween(1 - n, 0)


def running(*part: str, order: str = "date") -> Window:
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def full(expr: Column, value: Column | str, window, n: int) -> Column:
    """``expr`` where the window has ``n`` values, else null."""
    return F.when(F.count(col(value)).over(window) == n, expr)


def compound(r: Column | str, window) -> Column:
    """Product of 1 + r over a window.  Signs and zeros are counted, so losses of 100 % and more are right."""
    g = 1 + col(r)
    zero = F.sum(F.when(g == 0, 1).otherwise(0)).over(window)
    sign = F.sum(F.when(g < 0, 1).otherwise(0)).over(window)
    size = F.exp(F.sum(F.log(F.when(g != 0, F.abs(g)))).over(window))
    return F.when(zero > 0, F.lit(0.0)).otherwise(F.coalesce(size, F.lit(1.0)) * F.when(sign % 2 == 1, -1).otherwise(1))


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(low, F.least(high, col(c)))


def p_value(t: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(t) / math.sqrt(2))


def p_value_column(t: Column | str) -> Column:
    """Two-sided normal p-value by the continued approximation of the complementary error function
    (relative error below 1.2e-7)."""
    x = F.abs(col(t)) / math.sqrt(2)
    k = 1 / (1 + 0.5 * x)
    # Coefficients of the rational Chebyshev fit, from the constant term up.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda a, b: a * k + b, [F.lit(c) for c in reversed(fit)])
    return k * F.exp(-x * x + poly)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_density(x: float) -> float:
    return NormalDist().pdf(x)
