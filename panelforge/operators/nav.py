"""Rank buckets of a score: daily returns, net asset value, summaries, composition, constituents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import passing, require_columns, unique
from ..functions.keys import finite
from ..functions.stats import YEAR, annual_ratio, annual_vol, positive_rate, t_stat

DAY = ("fold_id", "split", "date")
SERIES = ("fold_id", "split", "bucket_index", "bucket_label")
SIZE_METRICS = ("market_cap", "log_mcap", "log_mcap_z", "mcap_rank", "size_decile")


@dataclass(frozen=True)
class RankBucket:
    """Ranks ``start`` to ``end``, both included."""

    label: str
    start: int
    end: int


def parse_rank_bucket(text: str) -> RankBucket:
    """``START:END=label``"""
    bounds, _, label = text.partition("=")
    start, _, end = bounds.partition(":")
    return RankBucket(label or f"{start}_{end}", int(start), int(end))


def check_rank_buckets(buckets: Sequence[RankBucket]) -> None:
    if len({b.label for b in buckets}) < len(buckets):
        raise ValueError("rank bucket labels repeat")
    ordered = sorted(buckets, key=lambda b: b.start)
    if any(b.start < 1 or b.end < b.start for b in ordered) or any(b.start <= a.end for a, b in zip(ordered, ordered[1:], strict=False)):
        raise ValueError("rank buckets must be positive, ordered and must not overlap")


def default_rank_buckets(ranked: DataFrame, size: int) -> list[RankBucket]:
    """Buckets of ``size`` ranks up to the largest daily count."""
    most = ranked.agg(F.max("rank")).first()[0] or 0
    return [RankBucket(f"rank_{s:04d}_{s + size - 1:04d}", s, s + size - 1) for s in range(1, most + 1, size)]


def rank_scores(predictions: DataFrame, score: str, splits: Sequence[str] | None = None, fold_ids: Sequence[int] | None = None, descending: bool = True) -> DataFrame:
    """Rows with a finite score, ranked in each fold, split and date; ties go by stock code."""
    require_columns(predictions, [*DAY, "stock_code", score], "predictions")
    df = predictions
    if splits is not None:
        df = df.where(F.col("split").isin(*splits))
    if fold_ids is not None:
        df = df.where(F.col("fold_id").isin(*fold_ids))
    df = df.withColumn(score, finite(F.col(score)))
    by_score = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    w = Window.partitionBy(*DAY)
    df = df.withColumn("rank", F.row_number().over(w.orderBy(by_score, "stock_code"))).withColumn("eligible_count", F.count(score).over(w))
    return unique(df, [*DAY, "stock_code"], "predictions").where(F.col(score).isNotNull())


def _equal_start(k: Column, n: Column, buckets: int) -> Column:
    return (F.floor(n / buckets) * (k - 1) + F.least(k - 1, n % buckets) + 1).cast("int")


def assign_buckets(ranked: DataFrame, bucket_count: int | None = None, buckets: Sequence[RankBucket] | None = None) -> DataFrame:
    """Adds bucket_index, bucket_label, rank_start and rank_end; rows outside of fixed buckets go."""
    return _bucketed(ranked, bucket_count, buckets).where("bucket_index is not null")


def _bucketed(ranked: DataFrame, bucket_count: int | None, buckets: Sequence[RankBucket] | None) -> DataFrame:
    k = F.col("bucket_index")
    if bucket_count:
        tile = F.ntile(bucket_count).over(Window.partitionBy(*DAY).orderBy("rank"))
        df = ranked.withColumn("bucket_index", tile)
        return df.withColumn("bucket_label", F.format_string("bucket_%02d", k)).withColumn("rank_start", _equal_start(k, F.col("eligible_count"), bucket_count)).withColumn("rank_end", _equal_start(k + 1, F.col("eligible_count"), bucket_count) - 1)
    check_rank_buckets(buckets)
    specs = F.array(*[F.struct(F.lit(i).alias("bucket_index"), F.lit(b.label).alias("bucket_label"), F.lit(b.start).alias("rank_start"), F.lit(b.end).alias("rank_end")) for i, b in enumerate(buckets, 1)])
    spec = F.get(F.filter(specs, lambda b: F.col("rank").between(b["rank_start"], b["rank_end"])), 0)
    return ranked.withColumn("_b", spec).select("*", "_b.*").drop("_b")


def bucket_frame(ranked: DataFrame, bucket_count: int | None = None, buckets: Sequence[RankBucket] | None = None) -> DataFrame:
    """Every bucket of every day that has ranked rows, empty ones included, with its rank bounds."""
    return _bucket_days(ranked.groupBy(*DAY).agg(F.count("*").cast("int").alias("eligible_count")), bucket_count, buckets)


def _bucket_days(days: DataFrame, bucket_count: int | None, buckets: Sequence[RankBucket] | None) -> DataFrame:
    if bucket_count:
        df = days.withColumn("bucket_index", F.explode(F.sequence(F.lit(1), F.lit(bucket_count))))
        k, n = F.col("bucket_index"), F.col("eligible_count")
        return df.select("*", F.format_string("bucket_%02d", k).alias("bucket_label"), _equal_start(k, n, bucket_count).alias("rank_start"), (_equal_start(k + 1, n, bucket_count) - 1).alias("rank_end"))
    specs = F.array(*[F.struct(F.lit(i).alias("bucket_index"), F.lit(b.label).alias("bucket_label"), F.lit(b.start).alias("rank_start"), F.lit(b.end).alias("rank_end")) for i, b in enumerate(buckets, 1)])
    return days.select("*", F.inline(specs))


def bucket_returns(ranked: DataFrame, returns: DataFrame, bucket_count: int | None = None, buckets: Sequence[RankBucket] | None = None, min_names: int = 1, return_col: str = "value") -> DataFrame:
    """Equal-weight return of each bucket over its names with a return; null below ``min_names`` of them.

    ``returns`` is long (date, stock_code, ``return_col``). A return of -1 or less inside a bucket is an error.
    """
    keys = ["date", "stock_code"]
    prices = unique(returns.select(*keys, finite(F.col(return_col)).alias("_r")), keys, "returns")
    priced = _bucketed(ranked, bucket_count, buckets).drop("_r").join(prices, keys, "left")
    priced = passing(priced, F.col("bucket_index").isNull() | F.col("_r").isNull() | (F.col("_r") > -1), "bucket returns must be above -1", keys)
    # rows outside of fixed buckets (null index) are counted too, so each day is here without ranking twice
    sums = priced.groupBy(*DAY, "bucket_index").agg(
        F.first("eligible_count").cast("int").alias("eligible_count"), F.count("*").cast("int").alias("selected_count"), F.count("_r").cast("int").alias("valid_return_count"), F.avg("_r").alias("_mean")
    )
    held = F.when(F.col("bucket_index").isNotNull(), F.struct("bucket_index", F.struct("selected_count", "valid_return_count", "_mean")))
    days = sums.groupBy(*DAY).agg(F.first("eligible_count").alias("eligible_count"), F.map_from_entries(F.collect_list(held)).alias("_sums"))  # an entry per bucket
    whole = _bucket_days(days, bucket_count, buckets).withColumn("_sum", F.try_element_at("_sums", F.col("bucket_index"))).select("*", "_sum.*")
    selected, valid = F.coalesce("selected_count", F.lit(0)), F.coalesce("valid_return_count", F.lit(0))
    return whole.select(
        *SERIES,
        "date",
        "eligible_count",
        "rank_start",
        "rank_end",
        selected.alias("selected_count"),
        valid.alias("valid_return_count"),
        (selected - valid).alias("missing_return_count"),
        F.when(valid >= min_names, F.col("_mean")).alias("bucket_return"),
    )


def net_asset_value(daily: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Adds applied_return (0 where missing), nav_stale_flag, gross_nav and drawdown (against at least 1)."""
    w = Window.partitionBy(*series).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("applied_return", F.coalesce("bucket_return", F.lit(0.0))).withColumn("nav_stale_flag", F.col("bucket_return").isNull())
    df = df.withColumn("gross_nav", F.product(1 + F.col("applied_return")).over(w))
    return df.withColumn("drawdown", F.col("gross_nav") / F.greatest(F.lit(1.0), F.max("gross_nav").over(w)) - 1)


def _with_runs(nav: DataFrame, series: Sequence[str], tolerance: float) -> DataFrame:
    """Adds ``_below``: days that the run of days below the running high has in all, on its rows."""
    w = Window.partitionBy(*series).orderBy("date")
    high = F.greatest(F.lit(1.0), F.max("gross_nav").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = nav.withColumn("_at_high", F.col("gross_nav") >= high - tolerance)
    df = df.withColumn("_island", F.sum(F.col("_at_high").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("_below", F.sum((~F.col("_at_high")).cast("int")).over(Window.partitionBy(*series, "_island")))


def underwater_runs(nav: DataFrame, series: Sequence[str] = SERIES, tolerance: float = 0.0) -> DataFrame:
    """Longest run of days below the running high (at least 1) of each series."""
    return _with_runs(nav, series, tolerance).groupBy(*series).agg(F.max("_below").cast("int").alias("longest_underwater_days"))


def summarize_buckets(nav: DataFrame, series: Sequence[str] = SERIES, tolerance: float = 0.0) -> DataFrame:
    """Per series: dates, returns, net asset value, risk, counts, and the longest run below the running high less ``tolerance``."""
    r, n = F.col("bucket_return"), F.count("*")
    end = F.max_by("gross_nav", "date")
    return _with_runs(nav, series, tolerance).groupBy(*series).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        n.cast("int").alias("day_count"),
        F.count(r).cast("int").alias("valid_day_count"),
        F.avg(r).alias("mean_daily_return"),
        F.stddev_pop(r).alias("std_daily_return"),
        end.alias("final_nav"),
        (F.pow(end, F.lit(float(YEAR)) / n) - 1).alias("annualized_return"),
        annual_vol(r).alias("annualized_vol"),
        annual_ratio(r).alias("sharpe"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        positive_rate(r).alias("positive_rate"),
        F.avg("selected_count").alias("mean_selected"),
        F.avg("valid_return_count").alias("mean_valid"),
        F.min("valid_return_count").cast("int").alias("min_valid"),
        F.sum("missing_return_count").cast("long").alias("missing_sum"),
        F.max("_below").cast("int").alias("longest_underwater_days"),
    )


def attach_features(ranked: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join of the feature panel; every ranked row needs all ``columns``."""
    keys = ["date", "stock_code"]
    df = ranked.join(unique(features.select(*keys, *columns), keys, "feature panel"), keys, "left")
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    return passing(df, full, "ranked rows lack composition features", keys)


def constituents(bucketed: DataFrame, buckets: Sequence[int] | None = None) -> DataFrame:
    """Names of each bucket with their rank in it and equal weights."""
    df = bucketed if buckets is None else bucketed.where(F.col("bucket_index").isin(*buckets))
    w = Window.partitionBy(*DAY, "bucket_index")
    return df.select(*SERIES, "date", "stock_code", "rank", F.row_number().over(w.orderBy("rank")).alias("rank_in_bucket"), (F.lit(1.0) / F.count("*").over(w)).alias("weight"))


def _shares(counts: DataFrame, keys: Sequence[str], category: str, out: str) -> DataFrame:
    counts = counts.where(F.col(category).isNotNull())
    return counts.withColumn(out, F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")


def category_composition(bucketed: DataFrame, ranked: DataFrame, category: str) -> DataFrame:
    """Per day and bucket: weight of every category of the day's universe, its universe weight, and the difference.

    ``bucketed`` and ``ranked`` carry ``category``; categories that a bucket lacks weigh 0 there.
    """
    universe = _shares(ranked.groupBy(*DAY, category).agg(F.count("*").alias("_n")), DAY, category, "universe_weight")
    # one aggregation (its shuffle is reused) gives the buckets that there are and their shares
    counts = bucketed.groupBy(*DAY, "bucket_index", "bucket_label", category).agg(F.count("*").alias("_n"))
    frame = counts.select(*DAY, "bucket_index", "bucket_label").distinct().join(universe, list(DAY))
    own = _shares(counts.drop("bucket_label"), [*DAY, "bucket_index"], category, "bucket_weight")
    df = frame.join(own, [*DAY, "bucket_index", category], "left").withColumn("bucket_weight", F.coalesce("bucket_weight", F.lit(0.0)))
    return df.withColumn("active_weight", F.col("bucket_weight") - F.col("universe_weight"))


def size_composition(bucketed: DataFrame, ranked: DataFrame, metrics: Sequence[str] = SIZE_METRICS) -> DataFrame:
    """Means of the size metrics per day and bucket against the day's universe, one row per metric."""
    means = [F.avg(finite(F.col(m))).alias(m) for m in metrics]
    own = bucketed.groupBy(*DAY, "bucket_index", "bucket_label").agg(*means).unpivot([*DAY, "bucket_index", "bucket_label"], list(metrics), "metric", "bucket_value")
    universe = ranked.groupBy(*DAY).agg(*means).unpivot(list(DAY), list(metrics), "metric", "universe_value")
    return own.join(universe, [*DAY, "metric"]).withColumn("active_value", F.col("bucket_value") - F.col("universe_value"))


def summarize_composition(daily: DataFrame, segment: str, bucket: str = "bucket_weight", universe: str = "universe_weight", active: str = "active_weight", keys: Sequence[str] = SERIES) -> DataFrame:
    """Means over dates of bucket, universe and active values, with the active value's deviation, t and share of days above 0."""
    a = F.col(active)
    return daily.groupBy(*keys, segment).agg(
        F.count(a).cast("int").alias("day_count"),
        F.avg(bucket).alias("mean_bucket"),
        F.avg(universe).alias("mean_universe"),
        F.avg(a).alias("mean_active"),
        F.stddev_pop(a).alias("std_active"),
        t_stat(a).alias("t_active"),
        positive_rate(a).alias("positive_rate"),
    )


def rank_bucket_nav(
    predictions: DataFrame,
    returns: DataFrame,
    score: str,
    features: DataFrame | None = None,
    splits: Sequence[str] | None = None,
    fold_ids: Sequence[int] | None = None,
    bucket_count: int | None = None,
    buckets: Sequence[RankBucket] | None = None,
    bucket_size: int = 500,
    descending: bool = True,
    min_names: int = 1,
    target_buckets: Sequence[int] | None = None,
) -> dict[str, DataFrame]:
    """All tables of one score: daily_returns, nav, summary, and with ``features`` (industry and size metrics)
    constituents and industry and size composition, daily and summarised."""
    ranked = rank_scores(predictions, score, splits, fold_ids, descending)
    if not bucket_count and not buckets:
        buckets = default_rank_buckets(ranked, bucket_size)
    daily = bucket_returns(ranked, returns, bucket_count, buckets, min_names)
    nav = net_asset_value(daily)
    out = {"daily_returns": daily, "nav": nav, "summary": summarize_buckets(nav)}
    if features is not None:
        ranked = attach_features(ranked, features, ["industry", *SIZE_METRICS])
        chosen = assign_buckets(ranked, bucket_count, buckets)
        if target_buckets is not None:
            chosen = chosen.where(F.col("bucket_index").isin(*target_buckets))
        industry, size = category_composition(chosen, ranked, "industry"), size_composition(chosen, ranked)
        deciles = category_composition(chosen, ranked, "size_decile")
        out |= {
            "constituents": constituents(chosen),
            "industry_daily": industry,
            "industry_summary": summarize_composition(industry, "industry"),
            "size_daily": size,
            "size_summary": summarize_composition(size, "metric", "bucket_value", "universe_value", "active_value"),
            "size_decile_daily": deciles,
        }
    return out
