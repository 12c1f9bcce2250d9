"""Evaluation of scores: daily information coefficients, spreads, group coefficients, feature gains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import consistent, matched, passing, unique
from ..functions.keys import category_label, finite
from ..functions.stats import annual_ratio, correlation, positive_rate
from .xsection import average_rank, quantile_bucket

DAY = ("fold_id", "split", "date")


def evaluation_frame(predictions: DataFrame, panel: DataFrame, context: Sequence[str], checked: Sequence[str] = ()) -> DataFrame:
    """Predictions with the panel's ``context`` columns; every prediction needs its panel row, and ``checked`` columns must agree."""
    keys = ["date", "stock_code"]
    copies = [F.col(c).alias(f"_panel_{c}") for c in checked]
    # both checks of repeated rows are dealt as the join is
    df = matched(predictions, unique(panel.select(*keys, *context, *copies), keys, "panel"), keys, "predictions without panel rows")
    df = consistent(df, [(c, f"_panel_{c}") for c in checked], keys).drop(*[f"_panel_{c}" for c in checked])
    return unique(df, [*keys, "fold_id", "split"], "predictions")


def long_scores(frame: DataFrame, scores: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per score and row whose score and target are finite."""
    ids = [*DAY, "stock_code", *keep]
    df = frame.select(*ids, finite(F.col(target)).alias("target"), *[finite(F.col(s)).alias(s) for s in scores])
    return df.unpivot([*ids, "target"], list(scores), "score_col", "score").where("score is not null and target is not null")


def daily_ic(frame: DataFrame, scores: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation of score and target per fold, split, date, score and ``by``."""
    keys = [*DAY, "score_col", *by]
    pairs = long_scores(frame, scores, target, by)
    ranked = pairs.withColumn("_s", average_rank("score", keys)).withColumn("_t", average_rank("target", keys))
    return ranked.groupBy(*keys).agg(F.count("*").cast("int").alias("n_obs"), correlation("score", "target").alias("ic"), correlation("_s", "_t").alias("rank_ic"))


def summarize_ic(ic: DataFrame, by: Sequence[str] = ("fold_id", "split", "score_col")) -> DataFrame:
    a, b = F.col("ic"), F.col("rank_ic")
    return ic.groupBy(*by).agg(
        F.count("*").cast("int").alias("date_count"),
        F.sum("n_obs").cast("long").alias("total_obs"),
        F.count(a).cast("int").alias("valid_ic_count"),
        F.avg(a).alias("mean_ic"),
        F.stddev_pop(a).alias("std_ic"),
        annual_ratio(a).alias("ic_ir"),
        positive_rate(a).alias("ic_positive_rate"),
        F.avg(b).alias("mean_rank_ic"),
        F.stddev_pop(b).alias("std_rank_ic"),
        annual_ratio(b).alias("rank_ic_ir"),
        positive_rate(b).alias("rank_ic_positive_rate"),
    )


def top_bottom_spread(frame: DataFrame, scores: Sequence[str], target: str, quantiles: int = 10, least: int = 2) -> DataFrame:
    """Mean target of the top and bottom score quantile and their difference; days with constant scores are left out."""
    keys = [*DAY, "score_col"]
    pairs = long_scores(frame, scores, target)
    w = Window.partitionBy(*keys)
    varied = pairs.withColumn("_varied", F.min("score").over(w) < F.max("score").over(w)).withColumn("_n", F.count("*").over(w)).where(F.col("_varied") & (F.col("_n") >= least))
    df = varied.withColumn("q", quantile_bucket("score", quantiles, keys)).withColumn("top", F.least(F.lit(quantiles), F.col("_n")))
    top, bottom = F.col("q") == F.col("top"), F.col("q") == 1
    mean = lambda c: F.avg(F.when(c, F.col("target")))
    out = df.groupBy(*keys).agg(mean(top).alias("top_mean"), mean(bottom).alias("bottom_mean"), F.count_if(top).cast("int").alias("top_count"), F.count_if(bottom).cast("int").alias("bottom_count"))
    return out.withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))


def summarize_spread(spread: DataFrame, by: Sequence[str] = ("fold_id", "split", "score_col")) -> DataFrame:
    x = F.col("spread")
    return spread.groupBy(*by).agg(F.count("*").cast("int").alias("date_count"), F.avg("top_mean").alias("mean_top"), F.avg("bottom_mean").alias("mean_bottom"), F.avg(x).alias("mean_spread"), F.stddev_pop(x).alias("std_spread"), annual_ratio(x).alias("spread_ir"), positive_rate(x).alias("positive_rate"))


def add_condition_buckets(frame: DataFrame, columns: Mapping[str, str], buckets: int = 3) -> DataFrame:
    """Adds label columns per date (over all folds and splits): low, mid, high for three buckets, else q1, q2, ..."""
    for out, source in columns.items():
        k = quantile_bucket("_c", buckets, ("date",), ("stock_code", "fold_id", "split"))
        names = F.array(F.lit("low"), F.lit("mid"), F.lit("high"))
        n = F.count("_c").over(Window.partitionBy("date"))
        label = F.when(n >= 3, F.get(names, k - 1)).otherwise(F.format_string("q%d", k)) if buckets == 3 else F.format_string("q%d", k)
        frame = frame.withColumn("_c", finite(F.col(source))).withColumn(out, F.when(k.isNotNull(), label)).drop("_c")
    return frame


def group_ic(frame: DataFrame, scores: Sequence[str], target: str, dimensions: Sequence[str], least: int = 2) -> DataFrame:
    """Daily coefficients inside the groups of each dimension, of at least ``least`` rows; groups without any coefficient go."""
    stacked = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), category_label(F.col(d)).alias("group")) for d in dimensions]))
    df = frame.withColumn("_g", stacked).select("*", "_g.*").drop("_g").where(F.col("group").isNotNull())
    out = daily_ic(df, scores, target, ("dimension", "group"))
    return out.where((F.col("n_obs") >= least) & (F.col("ic").isNotNull() | F.col("rank_ic").isNotNull()))


def feature_gain(gains: DataFrame) -> DataFrame:
    """Shares, ranks and cumulative shares inside folds of (fold_id, feature, importance_gain, importance_split)."""
    df = unique(gains, ["fold_id", "feature"], "feature gains")
    for c in ("importance_gain", "importance_split"):
        df = df.withColumn(c, F.coalesce(finite(F.col(c)), F.lit(0.0)))
    df = passing(df, (F.col("importance_gain") >= 0) & (F.col("importance_split") >= 0), "feature gains must not be negative", ["fold_id", "feature"])
    w = Window.partitionBy("fold_id")
    order = w.orderBy(F.desc("importance_gain"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    for kind in ("gain", "split"):
        c = f"importance_{kind}"
        df = df.withColumn(f"{kind}_share", F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0))).withColumn(f"{kind}_rank", F.rank().over(w.orderBy(F.desc(c))))
    return df.withColumn("cumulative_gain_share", F.sum("gain_share").over(order))


def summarize_feature_gain(gain: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Per feature over folds; with ``roles`` (feature, role) also the role."""
    out = gain.groupBy("feature").agg(
        F.count("*").cast("int").alias("fold_count"),
        F.avg("importance_gain").alias("mean_gain"),
        F.avg("gain_share").alias("mean_gain_share"),
        F.stddev_pop("gain_share").alias("std_gain_share"),
        F.avg("gain_rank").alias("mean_gain_rank"),
        F.count_if(F.col("importance_gain") > 0).cast("int").alias("nonzero_folds"),
        F.avg("split_share").alias("mean_split_share"),
    )
    if roles is None:
        return out
    return matched(out, unique(roles, ["feature"], "feature roles"), ["feature"], "features without a role")


def summarize_roles(summary: DataFrame) -> DataFrame:
    """Per role: features, gain share, and the feature of the largest share (ties: the first by name)."""
    top = F.min(F.struct((-F.col("mean_gain_share")).alias("s"), "feature"))
    return summary.groupBy("role").agg(F.count("*").cast("int").alias("feature_count"), F.sum("mean_gain_share").alias("gain_share"), top["feature"].alias("top_feature"))


#: Columns of a panel that evaluations look for, in this order.
CONTEXT = ("industry", "board", "index_bucket", "size_decile", "mcap_rank", "log_mcap", "market_cap", "logADV20", "turnover20")
GROUPS = ("industry", "board", "index_bucket", "size_decile", "mcap_tercile", "adv_tercile", "turnover_tercile")
CONDITIONS = {"mcap_tercile": ("mcap_rank", "log_mcap", "market_cap"), "adv_tercile": ("logADV20",), "turnover_tercile": ("turnover20",)}
CHECKED = ("y_rank_label", "y_resid_fwd", "sample_weight")


@dataclass(frozen=True)
class Dimensions:
    """What an evaluation can use of its inputs."""

    context: tuple[str, ...]
    conditions: dict[str, str]
    groups: tuple[str, ...]
    checked: tuple[str, ...]


def discovered(predictions: DataFrame, panel: DataFrame, target: str, spread_target: str | None = None) -> Dimensions:
    """Context columns that the panel has, conditions that can be formed of them, groups that hold any value, and columns that both have.

    One aggregation over the panel counts the values of all candidates; a condition holds a value wherever its source does.
    """
    context = tuple(c for c in CONTEXT if c in panel.columns)
    conditions = {out: next(s for s in sources if s in context) for out, sources in CONDITIONS.items() if set(sources) & set(context)}
    both = dict.fromkeys((target, spread_target or target, *CHECKED))
    checked = tuple(c for c in both if c in panel.columns and c in predictions.columns)
    if not context:
        return Dimensions((), {}, (), checked)
    numbers = {s for sources in CONDITIONS.values() for s in sources}
    held = panel.agg(*[F.count(finite(F.col(c)) if c in numbers else F.col(c)).alias(c) for c in context]).first()
    groups = tuple(g for g in GROUPS if conditions.get(g, g) in context and held[conditions.get(g, g)])
    return Dimensions(context, conditions, groups, checked)


def evaluate_discovered(predictions: DataFrame, panel: DataFrame, scores: Sequence[str], target: str, quantiles: int = 10, buckets: int = 3, least: int = 2) -> dict[str, DataFrame]:
    """``evaluate_predictions`` by whatever dimensions the panel offers; columns that predictions have too must agree with the panel's."""
    d = discovered(predictions, panel, target)
    plain = [c for c in d.context if c not in predictions.columns]
    frame = add_condition_buckets(evaluation_frame(predictions, panel, plain, d.checked), d.conditions, buckets)
    return _tables(frame, scores, target, d.groups, quantiles, least)


def prediction_metrics(frame: DataFrame, scores: Sequence[str], target: str) -> DataFrame:
    """Per fold, split and score: dates with a coefficient, and mean and deviation of both kinds over the dates that have them."""
    ic = daily_ic(frame, scores, target)
    a, b = F.col("ic"), F.col("rank_ic")
    return ic.groupBy("fold_id", "split", "score_col").agg(F.count(a).alias("date_count"), F.avg(a).alias("mean_ic"), F.stddev_pop(a).alias("std_ic"), F.avg(b).alias("mean_rankic"), F.stddev_pop(b).alias("std_rankic"))


def evaluate_predictions(predictions: DataFrame, panel: DataFrame, scores: Sequence[str], target: str, context: Sequence[str], conditions: Mapping[str, str], quantiles: int = 10, least: int = 2) -> dict[str, DataFrame]:
    """All evaluation tables of the scores."""
    frame = add_condition_buckets(evaluation_frame(predictions, panel, context), conditions)
    return _tables(frame, scores, target, [c for c in (*context, *conditions) if c not in conditions.values()], quantiles, least)


def _tables(frame: DataFrame, scores: Sequence[str], target: str, dimensions: Sequence[str], quantiles: int, least: int) -> dict[str, DataFrame]:
    ic, spread = daily_ic(frame, scores, target), top_bottom_spread(frame, scores, target, quantiles)
    tables = {
        "frame": frame,
        "daily_ic": ic,
        "ic_summary": summarize_ic(ic),
        "spread_by_date": spread,
        "spread_summary": summarize_spread(spread),
    }
    if dimensions:
        groups = group_ic(frame, scores, target, dimensions, least)
        tables |= {"group_ic": groups, "group_ic_summary": summarize_ic(groups, ("fold_id", "split", "score_col", "dimension", "group"))}
    return tables
