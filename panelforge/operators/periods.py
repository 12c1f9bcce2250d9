"""Reporting periods: net asset value restarted per period, summaries, industry preferences; signal alignment and stitching."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import alongside, check_periods, matched, passing, require_columns, unique
from ..functions.keys import finite
from ..functions.stats import correlation
from .nav import DAY, bucket_returns, net_asset_value, rank_scores, summarize_buckets, summarize_composition
from .xsection import average_rank

PERIOD_SERIES = ("period", "bucket_index", "bucket_label")


@dataclass(frozen=True)
class Period:
    label: str
    start: dt.date
    end: dt.date


@dataclass(frozen=True)
class Segment:
    """Dates of a fold's split that a stitched series takes, and how many there have to be if that is known."""

    fold_id: int
    split: str
    start: dt.date
    end: dt.date
    date_count: int | None = None


def period_of(date: Column, periods: Sequence[Period]) -> Column:
    """Label of the period that holds the date, else null."""
    check_periods(periods)
    return F.coalesce(*[F.when(date.between(F.lit(p.start), F.lit(p.end)), p.label) for p in periods])


def in_periods(df: DataFrame, periods: Sequence[Period], splits: Sequence[str] | None = ("test",), date: str = "date") -> DataFrame:
    if splits is not None:
        df = df.where(F.col("split").isin(*splits))
    return df.withColumn("period", period_of(F.col(date), periods)).where(F.col("period").isNotNull())


def period_nav(daily_returns: DataFrame, periods: Sequence[Period], splits: Sequence[str] | None = ("test",)) -> DataFrame:
    """Net asset value of each bucket from the start of each period; folds are ignored, so dates must not repeat."""
    nav = net_asset_value(in_periods(daily_returns, periods, splits), PERIOD_SERIES)
    return unique(nav, ["period", "bucket_index", "date"], "period returns (without folds)")


def period_summary(daily_returns: DataFrame, periods: Sequence[Period], splits: Sequence[str] | None = ("test",)) -> DataFrame:
    summary = summarize_buckets(period_nav(daily_returns, periods, splits), PERIOD_SERIES)
    return summary.withColumn("empty_day_count", F.col("day_count") - F.col("valid_day_count"))


def requested_metrics(summary: DataFrame) -> DataFrame:
    """The period table with display names and zero-padded buckets."""
    return summary.select(
        "period",
        F.format_string("%02d", "bucket_index").alias("bucket"),
        F.col("final_nav").alias("nav"),
        F.col("annualized_return").alias("return_annualized"),
        F.col("annualized_vol").alias("volatility_annualized"),
        "sharpe",
        "max_drawdown",
        "longest_underwater_days",
    )


def period_industry_composition(industry_daily: DataFrame, periods: Sequence[Period], splits: Sequence[str] | None = ("test",)) -> DataFrame:
    df = in_periods(industry_daily, periods, splits)
    df = unique(df, ["period", "bucket_index", "industry", "date"], "period industry rows (without folds)")
    return summarize_composition(df, "industry", keys=PERIOD_SERIES)


def top_industry_preferences(summary: DataFrame, buckets: Sequence[int] = (1,), top_n: int = 10) -> DataFrame:
    """The ``top_n`` most over- and underweighted industries of each period and bucket."""
    df = summary.where(F.col("bucket_index").isin(*buckets))
    w = Window.partitionBy("period", "bucket_index")
    over = df.where("mean_active > 0").withColumn("side", F.lit("overweight")).withColumn("side_rank", F.row_number().over(w.orderBy(F.desc("mean_active"), "industry")))
    under = df.where("mean_active < 0").withColumn("side", F.lit("underweight")).withColumn("side_rank", F.row_number().over(w.orderBy("mean_active", "industry")))
    return over.unionByName(under).where(F.col("side_rank") <= top_n)


def daily_alignment(reference: DataFrame, candidate: DataFrame, reference_col: str, candidate_col: str, bucket_count: int = 31, splits: Sequence[str] | None = ("test",)) -> DataFrame:
    """Per fold, split and date: Spearman correlation of candidate and reference, and how many of the top names (a bucket's size) they share."""
    keys = ["date", "stock_code"]
    known = unique(reference.select(*keys, finite(F.col(reference_col)).alias("r")), keys, "reference")
    day = ["fold_id", "split", "date"]
    df = rank_scores(candidate, candidate_col, splits).select(*day, "stock_code", F.col(candidate_col).alias("c"))
    df = matched(df, known, keys, "candidate rows without a reference").where("r is not null")
    w = Window.partitionBy(*day)
    k = F.ceil(F.count("*").over(w) / bucket_count)
    df = df.withColumn("_top_c", F.row_number().over(w.orderBy(F.desc("c"), "stock_code")) <= k).withColumn("_top_r", F.row_number().over(w.orderBy(F.desc("r"), "stock_code")) <= k)
    df = df.withColumn("_rc", average_rank("c", day)).withColumn("_rr", average_rank("r", day))
    out = df.groupBy(*day).agg(
        F.count("*").cast("int").alias("n_obs"),
        correlation("_rc", "_rr").alias("spearman"),
        F.count_if("_top_c").cast("int").alias("top_count"),
        F.count_if(F.col("_top_c") & F.col("_top_r")).cast("int").alias("top_overlap"),
    )
    return out.withColumn("top_overlap_rate", F.try_divide(F.col("top_overlap"), F.col("top_count")))


def period_alignment(daily: DataFrame, periods: Sequence[Period], splits: Sequence[str] | None = ("test",)) -> DataFrame:
    df = in_periods(daily, periods, splits)
    s, o = F.col("spearman"), F.col("top_overlap_rate")
    return df.groupBy("period").agg(F.count("*").cast("int").alias("date_count"), F.avg(s).alias("mean_spearman"), F.median(s).alias("median_spearman"), F.avg(o).alias("mean_overlap"), F.median(o).alias("median_overlap"))


def stitch(predictions: DataFrame, segments: Sequence[Segment], score: str, fold_id: int = 0, split: str = "test") -> DataFrame:
    """One series from several folds: rows in a segment of their own fold and split, with where they came from.

    Segments must not overlap. A segment that knows its number of dates stops the query if the predictions have
    another one, as do rows that repeat a date and stock.
    """
    ordered = sorted(segments, key=lambda s: s.start)
    if any(b.start <= a.end for a, b in zip(ordered, ordered[1:], strict=False)):
        raise ValueError("segments overlap")
    hit = F.lit(False)
    for s in segments:
        hit = hit | ((F.col("fold_id") == s.fold_id) & (F.col("split") == s.split) & F.col("date").between(F.lit(s.start), F.lit(s.end)))
    taken = predictions.where(hit)
    out = taken.select(F.lit(fold_id).alias("fold_id"), F.lit(split).alias("split"), "date", "stock_code", F.col(score), F.col("fold_id").alias("source_fold_id"), F.col("split").alias("source_split"))
    out = unique(out, ["date", "stock_code"], "stitched predictions")
    known = [(s.fold_id, s.split, s.date_count) for s in segments if s.date_count is not None]
    if not known:
        return out
    # a segment has one fold and split, so its dates are told apart by these; there are a few segments
    expected = predictions.sparkSession.createDataFrame(known, "fold_id long, split string, expected_dates long")
    found = taken.groupBy(F.col("fold_id").cast("long").alias("fold_id"), "split").agg(F.countDistinct("date").alias("dates"))
    told = expected.join(found, ["fold_id", "split"], "left").withColumn("dates", F.coalesce("dates", F.lit(0)))
    return alongside(out, told, F.col("dates") == F.col("expected_dates"), "stitched dates differ from those of the training", ["fold_id", "split", "expected_dates", "dates"])


def source_segments(ranges: dict[int, dict[str, tuple[dt.date, dt.date]]], date_counts: Mapping[tuple[int, str], int] | None = None) -> list[Segment]:
    """All splits of the first fold, the test split of the others; ``date_counts`` by fold and split, as a training tells them."""
    first = min(ranges)
    return [Segment(f, s, *ranges[f][s], (date_counts or {}).get((f, s))) for f in sorted(ranges) for s in ("train", "valid", "test") if s in ranges[f] and (f == first or s == "test")]


def training_segments(folds: DataFrame) -> list[Segment]:
    """``source_segments`` of the ``folds`` table of a training (a row for each fold and split)."""
    rows = folds.collect()
    ranges: dict[int, dict[str, tuple[dt.date, dt.date]]] = {}
    for r in rows:
        ranges.setdefault(r["fold_id"], {})[r["split"]] = (r["start_date"], r["end_date"])
    return source_segments(ranges, {(r["fold_id"], r["split"]): r["date_count"] for r in rows})


def compare_signals(panel: DataFrame, template: DataFrame, returns: DataFrame, signals: dict[str, str], periods: Sequence[Period], bucket_count: int = 31, splits: Sequence[str] = ("test",), min_names: int = 1) -> DataFrame:
    """Period summaries of several signal columns of ``panel`` on the rows of ``template``, in one plan keyed by signal_id.

    Ranks, buckets (empty ones too) and returns are those of ``nav``. Rows of the template, panel or returns that repeat their keys
    or lack one, template rows without panel rows, and returns of -1 and less inside a bucket stop the query.
    """
    keys = ["date", "stock_code"]
    require_columns(template, [*DAY, "stock_code"], "template")
    require_columns(panel, [*keys, *signals.values()], "panel")
    named = F.col("date").isNotNull() & (F.coalesce("stock_code", F.lit("")) != "")
    rows = passing(template.select(*DAY, "stock_code"), named, "template rows without a date or stock", [*DAY, "stock_code"]).where(F.col("split").isin(*splits))
    rows = unique(rows, [*DAY, "stock_code"], "template")
    known = passing(panel.select(*keys, *[finite(F.col(c)).alias(i) for i, c in signals.items()]), named, "panel rows without a date or stock", keys)
    df = matched(rows, unique(known, keys, "panel"), keys, "template rows without panel rows")
    long = df.unpivot([*DAY, "stock_code"], list(signals), "signal_id", "score")
    # a fold of its own for each signal lets one plan rank and price them all
    fold = F.concat_ws("|", F.col("fold_id").cast("string"), "signal_id")
    daily = bucket_returns(rank_scores(long.withColumn("fold_id", fold), "score"), returns, bucket_count, min_names=min_names)
    daily = daily.withColumn("signal_id", F.regexp_replace("fold_id", r"^[^|]*\|", ""))
    series = ("signal_id", *PERIOD_SERIES)
    nav = unique(net_asset_value(in_periods(daily, periods, splits), series), [*series, "date"], "period returns (without folds)")
    return summarize_buckets(nav, series)
