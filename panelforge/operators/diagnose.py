"""Diagnosis of models and transforms: weighted metrics, styles, smoothed series, example stocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import finite
from ..functions.quantiles import exact_quantiles
from ..functions.stats import TINY
from .nav import SERIES, net_asset_value, summarize_buckets


def weighted_mean(summary: DataFrame, metric: str, weight: str = "date_count", by: Sequence[str] = ("split", "score_col")) -> DataFrame:
    """Mean of a fold metric weighted by its dates; folds without the metric take no part."""
    known = F.when(F.col(metric).isNotNull(), F.col(weight))
    return summary.groupBy(*by).agg(F.try_divide(F.sum(F.col(metric) * F.col(weight)), F.sum(known)).alias(f"weighted_{metric}"), F.sum(known).alias("total_weight"))


def stitched_summary(daily_returns: DataFrame, splits: Sequence[str] = ("test",)) -> DataFrame:
    """Bucket summaries over all folds as one series per bucket, missing returns as 0, highs within rounding."""
    series = ("bucket_index", "bucket_label")
    one = daily_returns.where(F.col("split").isin(*splits)).withColumn("bucket_return", F.coalesce(finite(F.col("bucket_return")), F.lit(0.0)))
    nav = net_asset_value(one, series)
    return summarize_buckets(nav, series, TINY)


def bucket_style(summary: DataFrame, segment: str, by: Sequence[str] = SERIES) -> DataFrame:
    """How far a bucket is from its universe: half the sum of absolute active weights, the largest one, and its segment."""
    a = F.abs(F.col("mean_active"))
    return summary.groupBy(*by).agg((F.sum(a) / 2).alias("active_share"), F.max(a).alias("largest_active"), F.min(F.struct((-F.round(a, 10)).alias("a"), segment))[segment].alias("largest_segment"))


def extreme_segments(summary: DataFrame, segment: str, n: int = 10, by: Sequence[str] = SERIES) -> DataFrame:
    """The ``n`` segments of largest and of smallest active weight per bucket."""
    w = Window.partitionBy(*by)
    a = F.round("mean_active", 10)
    df = summary.withColumn("from_top", F.row_number().over(w.orderBy(a.desc(), segment))).withColumn("from_bottom", F.row_number().over(w.orderBy(a.asc(), segment)))
    return df.where((F.col("from_top") <= n) | (F.col("from_bottom") <= n))


def rolling_mean(df: DataFrame, value: str, by: Sequence[str], rows: int = 10) -> DataFrame:
    """Adds ``value``_rolling: the mean of the present values among the last ``rows`` rows."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(1 - rows, 0)
    return df.withColumn(f"{value}_rolling", F.avg(value).over(w))


def series_z(df: DataFrame, value: str, by: Sequence[str] = ("stock_code",)) -> DataFrame:
    """Adds ``value``_z: standardised over the whole series; 0 for a constant one."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(value).over(w)
    return df.withColumn(f"{value}_z", F.when(F.col(value).isNotNull(), F.coalesce(F.when(s > TINY, (F.col(value) - F.avg(value).over(w)) / s), F.lit(0.0))))


def series_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, min, median, p95, p99 and max of each column: one row per column."""
    long = df.unpivot([], list(columns), "column", "v").withColumn("v", finite(F.col("v")))
    ranks = exact_quantiles(long, "column", "v", (0.5, 0.95, 0.99)).select("column", F.col("p50").alias("median"), "p95", "p99")
    own = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return own.join(ranks, "column", "left").select("column", "count", "mean", "min", "median", "p95", "p99", "max")


def trading_days_between(spans: DataFrame, calendar: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Adds days_between: calendar days strictly inside each span, 0 if the end is not later, null if a side is missing.

    Spans are joined to numbered days by equality, on the last calendar day not after the start and the first not before the end.
    """
    days = calendar.select("date").distinct()
    points = spans.select(F.col(start).alias("d")).unionByName(spans.select(F.col(end).alias("d"))).where("d is not null").distinct()
    both = points.select("d", F.lit(0).alias("open")).unionByName(days.select(F.col("date").alias("d"), F.lit(1).alias("open")))
    per_day = both.groupBy("d").agg(F.max("open").alias("open"))
    upto = F.sum("open").over(Window.orderBy("d"))  # a row per day
    at = per_day.select("d", upto.alias("upto"), (upto - F.col("open")).alias("before"))
    a = at.select(F.col("d").alias(start), F.col("upto").alias("_upto"))
    b = at.select(F.col("d").alias(end), F.col("before").alias("_before"))
    return spans.join(a, start, "left").join(b, end, "left").withColumn("days_between", F.when(F.col(end) <= F.col(start), F.lit(0)).otherwise(F.col("_before") - F.col("_upto"))).drop("_upto", "_before")


def one_hot_summary(matrix: DataFrame) -> DataFrame:
    """Rows set in each one-hot column."""
    columns = [c for c in matrix.columns if "__" in c]
    if not columns:
        return matrix.sparkSession.createDataFrame([], "column string, rows_set long, dates long")
    long = matrix.unpivot(["date"], columns, "column", "v")
    return long.groupBy("column").agg(F.sum("v").cast("long").alias("rows_set"), F.countDistinct(F.when(F.col("v") == 1, F.col("date"))).alias("dates"))


def example_stocks(raw: DataFrame, residual: DataFrame, n: int = 6) -> DataFrame:
    """Stocks to show before and after a transform: the largest reduction of the deviation first, ties by coverage and code."""
    keys = ["date", "stock_code"]
    df = raw.select(*keys, finite(F.col("value")).alias("a")).join(residual.select(*keys, finite(F.col("residual")).alias("b")), keys)
    g = df.groupBy("stock_code").agg(F.count("b").alias("coverage"), F.stddev_pop("a").alias("raw_std"), F.stddev_pop("b").alias("residual_std"))
    return g.withColumn("reduction", F.round(F.col("raw_std") - F.col("residual_std"), 10)).where("reduction is not null").orderBy(F.desc("reduction"), F.desc("coverage"), "stock_code").limit(n)


def natural_key(value: Column) -> Column:
    """Sorts numbers by size before texts by name."""
    number = value.try_cast("double")
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), value.cast("string").alias("text"))


@dataclass(frozen=True)
class SignalVariant:
    signal_id: str
    column: str
    label: str


def signal_variants(name: str, wanted: Sequence[str] | None = None) -> dict[str, SignalVariant]:
    """The raw and neutralised value and rank of one signal, by id."""
    known = {f"{kind}_{form}": SignalVariant(f"{kind}_{form}", f"{name}{'_neutralized' if kind == 'neutralized' else ''}_{'z' if form == 'value' else 'rank'}", f"{name} {kind} {form}") for kind in ("raw", "neutralized") for form in ("value", "rank")}
    unknown = sorted(set(wanted or ()) - set(known))
    if unknown:
        raise ValueError(f"unknown signal variants: {unknown}")
    return {k: known[k] for k in (wanted or known)}
