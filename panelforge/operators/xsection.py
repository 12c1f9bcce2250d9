"""Cross-sectional transforms: ranks, robust z-scores, deciles and quantile buckets inside groups.

All are window expressions over one partitioning, so any number of them shares one shuffle: nulls and ties are
told apart by order and frame, never by further partition columns. Each ranked column is one sort; the
order-free statistics of all columns are taken together. Values have to be finite or null (``functions.keys.finite``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import finite
from ..functions.stats import TINY

DAY = ("date",)


def average_rank(value: str, by: Sequence[str] = DAY, valid: Column | None = None) -> Column:
    """Rank from 1, ties get their mean; null where the value is null (or not ``valid``)."""
    x = F.col(value) if valid is None else F.when(valid, F.col(value))
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(x).over(ties) - 1) / 2.0)


def centered_rank(value: str, by: Sequence[str] = DAY, valid: Column | None = None) -> Column:
    """(average rank - 1/2) / n - 1/2, of mean zero."""
    x = F.col(value) if valid is None else F.when(valid, F.col(value))
    return (average_rank(value, by, valid) - 0.5) / F.count(x).over(Window.partitionBy(*by)) - 0.5


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def add_robust_z(df: DataFrame, value: str, out: str, by: Sequence[str] = DAY, lower: float = 0.01, upper: float = 0.99, z_clip: float = 5.0) -> DataFrame:
    """Adds ``out``: winsorised by exact quantiles, centred by the median, scaled by 1.4826 times the median
    absolute deviation (if that vanishes by the standard deviation, else by 1), and clipped."""
    return add_robust_zs(df, {out: value}, by, lower, upper, z_clip)


def add_robust_zs(df: DataFrame, sources: Mapping[str, str], by: Sequence[str] = DAY, lower: float = 0.01, upper: float = 0.99, z_clip: float = 5.0) -> DataFrame:
    """``add_robust_z`` of many columns (new name to source), in three steps over the group whatever their number."""
    w = Window.partitionBy(*by)
    numbered = dict(enumerate(sources.items()))
    edges = {f"_q{i}": F.percentile(F.col(v), F.array(F.lit(lower), F.lit(upper))).over(w) for i, (_, v) in numbered.items()}
    df = df.withColumns(edges)
    df = df.withColumns({f"_x{i}": _clip(F.col(v), F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]) for i, (_, v) in numbered.items()})
    df = df.withColumns({f"_m{i}": F.median(f"_x{i}").over(w) for i in numbered})
    spread = {f"_mad{i}": 1.4826 * F.median(F.abs(F.col(f"_x{i}") - F.col(f"_m{i}"))).over(w) for i in numbered}
    df = df.withColumns(spread | {f"_std{i}": F.stddev_pop(f"_x{i}").over(w) for i in numbered})

    def z(i: int) -> Column:
        mad, std = F.col(f"_mad{i}"), F.col(f"_std{i}")
        scale = F.when(mad > TINY, mad).when(std > TINY, std).otherwise(1.0)
        return _clip((F.col(f"_x{i}") - F.col(f"_m{i}")) / scale, F.lit(-z_clip), F.lit(z_clip))

    df = df.withColumns({out: z(i) for i, (out, _) in numbered.items()})
    return df.drop(*[f"_{k}{i}" for i in numbered for k in ("q", "x", "m", "mad", "std")])


def add_score_z(df: DataFrame, value: str, out: str, by: Sequence[str] = ("fold_id", "split", "date"), z_clip: float = 5.0) -> DataFrame:
    """Adds ``out``: robust z without winsorising; 0 where the score is missing or the scale vanishes."""
    w = Window.partitionBy(*by)
    df = df.withColumn("_m", F.median(value).over(w))
    df = df.withColumn("_mad", 1.4826 * F.median(F.abs(F.col(value) - F.col("_m"))).over(w))
    z = F.when(F.col("_mad") > TINY, _clip((F.col(value) - F.col("_m")) / F.col("_mad"), F.lit(-z_clip), F.lit(z_clip)))
    return df.withColumn(out, F.coalesce(z, F.lit(0.0))).drop("_m", "_mad")


def first_rank(value: str, by: Sequence[str], tie: Sequence[str], descending: bool = False) -> Column:
    """1, 2, ... by value and then the ``tie`` columns; null where the value is null."""
    x = F.col(value)
    order = Window.partitionBy(*by).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last(), *tie)
    return F.when(x.isNotNull(), F.row_number().over(order))


def decile(value: str, by: Sequence[str] = DAY, tie: Sequence[str] = ("stock_code",)) -> Column:
    """0-9 by position, -1 where the value is missing."""
    n = F.count(value).over(Window.partitionBy(*by))
    return F.coalesce(F.ceil(10 * first_rank(value, by, tie) / n) - 1, F.lit(-1)).cast("int")


def quantile_bucket(value: str, buckets: int, by: Sequence[str], tie: Sequence[str] = ("stock_code",), least: int = 2) -> Column:
    """1..min(buckets, n) by equal quantiles of positions; null below ``least`` values.

    Bucket k ends at position 1 + k (n - 1) / q, its edge included.
    """
    n = F.count(value).over(Window.partitionBy(*by))
    q = F.least(F.lit(buckets), n)
    position = first_rank(value, by, tie)
    return F.when(n >= least, F.greatest(F.ceil((position - 1) * q / (n - 1)), F.lit(1))).cast("int")


TRANSFORMS = ("identity", "log1p_nonnegative", "log_positive")


def transformed(value: Column, transform: str) -> Column:
    """The value in its domain, null outside of it."""
    x = finite(value)
    if transform == "identity":
        return x
    if transform == "log1p_nonnegative":
        return F.when(x >= 0, F.log1p(x))
    if transform == "log_positive":
        return F.when(x > 0, F.log(x))
    raise ValueError(f"unknown transform {transform!r}, expected one of {TRANSFORMS}")


@dataclass(frozen=True)
class Feature:
    """A column to be ranked and standardised as ``name``_rank and ``name``_z. Ranks are of the raw values
    unless ``rank_transformed``; values outside the transform's domain are missing in both."""

    source: str
    name: str
    transform: str = "identity"
    rank_transformed: bool = False

    def inside(self) -> Column:
        return transformed(F.col(self.source), self.transform)


def add_ranks_and_zs(df: DataFrame, features: Sequence[Feature], valid: Column | None = None, by: Sequence[str] = DAY, lower: float = 0.01, upper: float = 0.99, z_clip: float = 5.0) -> DataFrame:
    """Adds rank and z of all ``features``."""
    if not features:
        return df
    at = dict(enumerate(features))
    df = df.withColumns({f"_z_in{i}": f.inside() if valid is None else F.when(valid, f.inside()) for i, f in at.items()})
    df = df.withColumns({f"_r_in{i}": F.col(f"_z_in{i}") if f.rank_transformed else F.when(F.col(f"_z_in{i}").isNotNull(), F.col(f.source).cast("double")) for i, f in at.items()})
    df = df.withColumns({f"{f.name}_rank": centered_rank(f"_r_in{i}", by) for i, f in at.items()})
    df = add_robust_zs(df, {f"{f.name}_z": f"_z_in{i}" for i, f in at.items()}, by, lower, upper, z_clip)
    return df.drop(*[f"_{k}_in{i}" for i in at for k in ("z", "r")])


def add_rank_and_z(
    df: DataFrame,
    source: str,
    name: str,
    transform: str = "identity",
    valid: Column | None = None,
    rank_transformed: bool = False,
    by: Sequence[str] = DAY,
    lower: float = 0.01,
    upper: float = 0.99,
    z_clip: float = 5.0,
) -> DataFrame:
    """Adds ``name``_rank and ``name``_z of one column."""
    return add_ranks_and_zs(df, [Feature(source, name, transform, rank_transformed)], valid, by, lower, upper, z_clip)
