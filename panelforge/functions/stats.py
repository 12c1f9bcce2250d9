"""Aggregate expressions on finite values. All deviations are those of the population."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantiles import quantile_name

YEAR = 252  # trading days
TINY = 1e-12


def guarded(value: Column, condition: Column) -> Column:
    return F.when(condition, value)


def correlation(x: str, y: str) -> Column:
    """Pearson's over pairs that are both present; null below two pairs or if one side is constant."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa > TINY) & (sb > TINY), F.try_divide(F.covar_pop(a, b), sa * sb))


def ratio_of_mean(x: Column, scale: Column) -> Column:
    s = F.stddev_pop(x)
    return F.when((F.count(x) >= 2) & (s > TINY), F.try_divide(F.avg(x) * scale, s))


def t_stat(x: Column) -> Column:
    return ratio_of_mean(x, F.sqrt(F.count(x)))


def annual_ratio(x: Column) -> Column:
    """Sharpe ratio of daily returns, or information ratio of daily coefficients."""
    return ratio_of_mean(x, F.lit(YEAR**0.5))


def annual_vol(x: Column) -> Column:
    return F.when(F.count(x) >= 2, F.stddev_pop(x) * YEAR**0.5)


def positive_rate(x: Column) -> Column:
    return F.avg(F.when(x.isNotNull(), (x > 0).cast("int")))


QUANTILES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975, 0.99, 0.995, 0.999)


def moments(x: Column) -> list[Column]:
    """count, mean, std, min and max."""
    return [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]


def distribution(x: Column, quantiles: tuple[float, ...] = QUANTILES) -> list[Column]:
    """``moments`` and exact quantiles p0_1, p0_5, ... of groups of bounded size, such as a date's stocks; ``quantiles`` has those of whole columns."""
    return [*moments(x), *[F.percentile(x, F.lit(q)).alias(quantile_name(q)) for q in quantiles]]
