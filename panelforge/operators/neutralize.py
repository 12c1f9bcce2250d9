"""Neutralisation of labels and signals by daily cross-sectional regression.

Each date is one regression of at most a few thousand stocks, so dates are the unit of parallel
work: rows are prepared by expressions, then ``applyInPandas`` solves a small dense system per date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import INDEX_FLAGS, category, finite
from ..functions.stats import correlation
from .xsection import average_rank, centered_rank, quantile_bucket

KEYS = ["date", "stock_code"]


@dataclass(frozen=True)
class NeutralizeConfig:
    """``ridge`` of 0 is least squares; a winsor bound of None leaves that side alone. A date needs ``least_rows``
    rows, and more than its design's columns plus ``column_buffer``."""

    winsor: tuple[float | None, float | None] = (0.01, 0.99)
    ridge: float = 1e-8
    flags: tuple[str, ...] = tuple(INDEX_FLAGS)
    extra: tuple[str, ...] = ()
    least_rows: int = 30
    column_buffer: int = 10
    start: dt.date | None = None
    eps: float = 1e-12

    def __post_init__(self) -> None:
        lower, upper = self.winsor
        rules = {
            "ridge must not be negative": self.ridge >= 0,
            "least_rows must be positive": self.least_rows > 0,
            "column_buffer must not be negative": self.column_buffer >= 0,
            "the lower winsor bound must be in [0, 1)": lower is None or 0 <= lower < 1,
            "the upper winsor bound must be in (0, 1]": upper is None or 0 < upper <= 1,
            "the lower winsor bound must be below the upper": lower is None or upper is None or lower < upper,
            "eps must be positive": self.eps > 0,
        }
        broken = [rule for rule, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))

    @property
    def kind(self) -> str:
        return "exact_neutralization" if self.ridge <= self.eps else "approximate_neutralization"


EXACT = NeutralizeConfig(winsor=(None, None), ridge=0.0)


def _rank(x: np.ndarray) -> np.ndarray:
    return (pd.Series(x).rank(method="average").to_numpy() - 0.5) / len(x) - 0.5


def _winsorized(y: np.ndarray, lower: float | None, upper: float | None) -> np.ndarray:
    if lower is not None:
        y = np.maximum(y, np.quantile(y, lower))
    return y if upper is None else np.minimum(y, np.quantile(y, upper))


def weighted_std(x: np.ndarray, weights: np.ndarray | None = None, eps: float = 1e-12) -> float:
    """Deviation of the population; with ``weights`` (of sum 1) the weighted one, 0 where it is within ``eps``."""
    if weights is None:
        known = x[np.isfinite(x)]
        return float(known.std()) if len(known) else 0.0
    std = float(np.sqrt(weights @ (x - weights @ x) ** 2))
    return std if std > eps else 0.0


def _dummies(values: pd.Series) -> np.ndarray:
    levels = sorted(values.unique())[:-1]
    return np.column_stack([(values == v).to_numpy(float) for v in levels]) if levels else np.empty((len(values), 0))


def _numbers(day: pd.DataFrame, c: NeutralizeConfig) -> tuple[dict[str, np.ndarray], int]:
    """The continuous columns that vary on the date, and how many do not."""
    every = {f: day[f].to_numpy(float) for f in c.flags} | {"size_rank_norm": _rank(day["market_cap"].to_numpy(float))} | {e: day[e].to_numpy(float) for e in c.extra}
    varied = {n: x for n, x in every.items() if weighted_std(x) > c.eps}
    return varied, len(every) - len(varied)


def _solve(x: np.ndarray, y: np.ndarray, ridge: float, eps: float) -> tuple[np.ndarray, str]:
    """Coefficients and the solver's name (fixed values: lstsq, solve, lstsq_normal_equation)."""
    if ridge <= eps:
        return np.linalg.lstsq(x, y, rcond=None)[0], "lstsq"
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0.0  # not the intercept
    gram, right = x.T @ x / len(y) + np.diag(penalty), x.T @ y / len(y)
    try:
        return np.linalg.solve(gram, right), "solve"
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, right, rcond=None)[0], "lstsq_normal_equation"


def _largest_mean(groups: pd.Series, residual: np.ndarray) -> float:
    return float(pd.Series(residual).groupby(groups.to_numpy()).mean().abs().max())


# The columns of residuals and diagnostics.
ROW = "date date, stock_code string, y double, residual double, rank_label double, method string, r2 double, n_used long, n_columns long, skipped_reason string"
DIAGNOSTICS = (
    "n_total long, n_valid_return long, n_valid_exposure long, missing_exposure_count long, dropped_constant_continuous_count long, skipped boolean, "
    "return_weighted_mean double, residual_weighted_mean double, residual_weighted_std double, max_abs_industry_mean_after double, max_abs_board_mean_after double, "
    "max_abs_continuous_exposure_after double, continuous_columns_used string"
)
_names = lambda schema: [f.split()[0] for f in schema.split(", ")]


def neutralize_tables(values: DataFrame, exposures: DataFrame, config: NeutralizeConfig | None = None) -> dict[str, DataFrame]:
    """``residuals`` (see ``neutralize``) and ``diagnostics``: a row for each date of ``values``.

    Both come from one pass of regressions. Diagnostics tell how many rows there are, are finite, have complete
    exposures and were used, the design, why the date was skipped (null: it was not), the share explained, and what
    is left after it: the mean and deviation of the residuals, their largest mean in an industry and in a board,
    and their largest mean product with a continuous column. Rows weigh alike.
    """
    c = config or NeutralizeConfig()
    numeric = ["market_cap", *c.flags, *c.extra]
    side = exposures.select(*KEYS, category(F.col("industry")).alias("industry"), category(F.col("board")).alias("board"), *[finite(F.col(n)).alias(n) for n in numeric], F.lit(True).alias("_known"))
    df = values.select(*KEYS, finite(F.col("value")).alias("y")).join(side, KEYS, "left")
    ok = F.coalesce(F.col("market_cap") > 0, F.lit(False)) & F.col("industry").isNotNull() & F.col("board").isNotNull()
    for n in numeric:
        ok = ok & F.col(n).isNotNull()
    df = df.withColumn("_ok", ok).withColumn("_known", F.coalesce("_known", F.lit(False)))
    names = [*_names(ROW), *_names(DIAGNOSTICS)]

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stock_code", kind="stable").reset_index(drop=True)
        twice = pdf["stock_code"].duplicated()
        if twice.any():
            raise ValueError(f"values or exposures repeats keys {KEYS}: {pdf['date'].iloc[0]}, {pdf['stock_code'][twice].iloc[0]}")
        given = pdf["y"].notna()
        used = pdf[pdf["_ok"] & given].reset_index(drop=True)
        out = pdf.loc[given, ["date", "stock_code", "y"]].reindex(columns=names)
        told = dict.fromkeys(names) | {
            "date": pdf["date"].iloc[0], "n_used": 0, "n_columns": 0, "n_total": len(pdf), "n_valid_return": int(given.sum()), "n_valid_exposure": 0,
            "missing_exposure_count": int(given.sum()), "dropped_constant_continuous_count": 0, "skipped": True, "continuous_columns_used": "",
        }

        def finished(reason: str | None) -> pd.DataFrame:
            told["skipped_reason"] = reason
            for n in ("method", "r2", "n_used", "n_columns", "skipped_reason"):
                out[n] = told[n]
            return pd.concat([out.astype(object), pd.DataFrame([told], columns=names, dtype=object)], ignore_index=True)

        # The reasons.
        if c.start is not None and pdf["date"].iloc[0] < c.start:
            return finished("before_start_date")
        if not pdf["_known"].any():
            return finished("missing_exposure_date")
        told |= {"n_valid_exposure": int(pdf["_ok"].sum()), "n_used": len(used), "missing_exposure_count": int(given.sum()) - len(used)}
        if len(used) < c.least_rows:
            return finished("too_few_valid_observations")
        numbers, dropped = _numbers(used, c)
        x = np.column_stack([np.ones(len(used)), _dummies(used["industry"]), _dummies(used["board"]), *numbers.values()])
        told |= {"n_columns": x.shape[1], "dropped_constant_continuous_count": dropped, "continuous_columns_used": ",".join(numbers)}
        if len(used) <= x.shape[1] + c.column_buffer:
            return finished("too_few_observations_for_design")
        y = _winsorized(used["y"].to_numpy(float), *c.winsor)
        beta, method = _solve(x, y, c.ridge, c.eps)
        residual = y - x @ beta
        at = out["stock_code"].isin(used["stock_code"])
        out.loc[at, "residual"], out.loc[at, "rank_label"] = residual, _rank(residual)
        total = y.var()
        told |= {
            "skipped": False, "method": method, "r2": 1 - (residual**2).mean() / total if total > c.eps else None, "return_weighted_mean": y.mean(),
            "residual_weighted_mean": residual.mean(), "residual_weighted_std": residual.std(),
            "max_abs_industry_mean_after": _largest_mean(used["industry"], residual), "max_abs_board_mean_after": _largest_mean(used["board"], residual),
            "max_abs_continuous_exposure_after": max((abs(float((n * residual).mean())) for n in numbers.values()), default=0.0),
        }
        return finished(None)

    whole = df.groupBy("date").applyInPandas(day, f"{ROW}, {DIAGNOSTICS}")
    lower, upper = c.winsor
    about = [F.lit(c.kind).alias("neutralization_type"), F.lit(float(c.ridge)).alias("ridge"), F.lit(lower).cast("double").alias("winsor_lower"), F.lit(upper).cast("double").alias("winsor_upper")]
    own = [n for n in names if n not in ("stock_code", "y", "residual", "rank_label")]
    # a date's diagnostics are the row without a stock
    return {"residuals": whole.where("stock_code is not null").select(*_names(ROW)), "diagnostics": whole.where("stock_code is null").select(*own, *about)}


def neutralize(values: DataFrame, exposures: DataFrame, config: NeutralizeConfig | None = None) -> DataFrame:
    """Residual and its centered rank for every finite value of (date, stock_code, value).

    ``exposures`` has industry, board, market_cap, the index flags and ``extra`` columns. Rows without complete
    exposures get no residual; a date with too few rows is skipped and says why. The size rank is
    taken over the rows used. Keys that repeat stop the query.
    """
    return neutralize_tables(values, exposures, config)["residuals"]


def neutralization_summary(diagnostics: DataFrame) -> DataFrame:
    """One row: dates, how many were processed and skipped, their range, and the largest of what is left after."""
    done = ~F.col("skipped")
    most = [F.max(F.when(done, F.abs(finite(F.col(c))))).alias(c) for c in ("max_abs_industry_mean_after", "max_abs_board_mean_after", "max_abs_continuous_exposure_after")]
    return diagnostics.agg(
        F.count("*").alias("date_count"), F.count_if(done).alias("processed_date_count"), F.count_if(~done).alias("skipped_date_count"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.first("neutralization_type").alias("neutralization_type"), *most,
    )


def skip_reasons(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where("skipped").groupBy("skipped_reason").agg(F.count("*").alias("dates"))


def largest_group_mean(result: DataFrame, exposures: DataFrame, category_col: str) -> DataFrame:
    """Largest absolute mean residual of a category per date; about 0 after an exact run."""
    means = result.where("residual is not null").join(exposures.select(*KEYS, category_col), KEYS).groupBy("date", category_col).agg(F.avg("residual").alias("m"))
    return means.groupBy("date").agg(F.max(F.abs(F.col("m"))).alias("largest_group_mean"))


def neutralize_signal(signal: DataFrame, exposures: DataFrame, config: NeutralizeConfig | None = None) -> dict[str, DataFrame]:
    """A signal's value and its centered rank, both neutralised without winsorising."""
    return {kind: t["residuals"] for kind, t in _both_kinds(signal, exposures, config).items()}


def _both_kinds(signal: DataFrame, exposures: DataFrame, config: NeutralizeConfig | None) -> dict[str, dict[str, DataFrame]]:
    c = config or EXACT
    ranks = signal.select(*KEYS, centered_rank("value").alias("value"))
    return {"value": neutralize_tables(signal, exposures, c), "rank": neutralize_tables(ranks, exposures, c)}


def signal_neutralization_diagnostics(signals: Mapping[str, DataFrame], exposures: DataFrame, names: Sequence[str], config: NeutralizeConfig | None = None) -> DataFrame:
    """Diagnostics of the signals in ``names``, as values and as ranks, marked by signal_name and input_kind."""
    unknown = sorted(set(names) - set(signals))
    if unknown:
        raise ValueError(f"signals to neutralise are missing: {unknown}")
    marked = [t["diagnostics"].select(F.lit(n).alias("signal_name"), F.lit(kind).alias("input_kind"), "*") for n in names for kind, t in _both_kinds(signals[n], exposures, config).items()]
    return reduce(DataFrame.unionByName, marked)


def kind_summary(marked: DataFrame) -> DataFrame:
    """``neutralization_summary`` for each signal_name and input_kind of marked diagnostics."""
    done = ~F.col("skipped")
    most = [F.max(F.when(done, F.abs(finite(F.col(c))))).alias(c) for c in ("max_abs_industry_mean_after", "max_abs_board_mean_after", "max_abs_continuous_exposure_after")]
    return marked.groupBy("signal_name", "input_kind").agg(F.count("*").alias("date_count"), F.count_if(done).alias("processed_date_count"), F.count_if(~done).alias("skipped_date_count"), F.first("neutralization_type").alias("neutralization_type"), *most)


def risk_r2(frame: DataFrame, scores: Sequence[str], categories: Sequence[str], numbers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """How much of each score the risk columns explain per date: (date, score, r2, adjusted r2), and residual scores."""
    fields = "date date, stock_code string, score_col string, n_obs long, r2 double, adj_r2 double, residual_score double"

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stock_code", kind="stable")
        full = [np.ones((len(pdf), 1))]
        for c in categories:
            levels = sorted(pdf[c].dropna().unique())
            full.append(np.column_stack([(pdf[c] == v).to_numpy(float) for v in levels]) if levels else np.empty((len(pdf), 0)))
        full.append(pdf[list(numbers)].to_numpy(float))
        design, rows = np.nan_to_num(np.hstack(full)), []
        for s in scores:
            y = pdf[s].to_numpy(float)
            use = np.isfinite(y)
            n = int(use.sum())
            r2 = adj = np.nan
            res = np.full(len(y), np.nan)
            if n >= 2:
                beta, _, rank, _ = np.linalg.lstsq(design[use], y[use], rcond=None)
                res[use] = y[use] - design[use] @ beta
                total = ((y[use] - y[use].mean()) ** 2).sum()
                if total > 1e-12:
                    r2 = 1 - (res[use] ** 2).sum() / total
                    adj = 1 - (1 - r2) * (n - 1) / (n - rank) if n > rank else np.nan
            rows.append(pd.DataFrame({"date": pdf["date"], "stock_code": pdf["stock_code"], "score_col": s, "n_obs": n, "r2": r2, "adj_r2": adj, "residual_score": res}))
        return pd.concat(rows)

    whole = frame.select(*KEYS, *scores, *categories, *numbers).groupBy("date").applyInPandas(day, fields)
    return whole.select("date", "score_col", "n_obs", "r2", "adj_r2").distinct(), whole.select(*KEYS, "score_col", "residual_score")


def summarize_r2(daily: DataFrame) -> DataFrame:
    x = finite(F.col("r2"))
    return daily.groupBy("score_col").agg(F.count(x).alias("date_count"), F.avg(x).alias("mean_r2"), F.median(x).alias("median_r2"), F.percentile(x, F.lit(0.9)).alias("p90_r2"), F.avg(finite(F.col("adj_r2"))).alias("mean_adj_r2"))


def decile_performance(frame: DataFrame, score: str, target: str) -> DataFrame:
    """Per date: IC, rank IC, and top minus bottom decile (null below ten rows or with one distinct score)."""
    df = frame.select(*KEYS, finite(F.col(score)).alias("s"), finite(F.col(target)).alias("t")).where("s is not null and t is not null")
    df = df.withColumn("q", quantile_bucket("s", 10, ("date",))).withColumn("rs", average_rank("s")).withColumn("rt", average_rank("t"))
    mean = lambda k: F.avg(F.when(F.col("q") == k, F.col("t")))
    enough = (F.count("*") >= 10) & (F.min("s") < F.max("s"))
    return df.groupBy("date").agg(F.count("*").alias("n_obs"), correlation("s", "t").alias("ic"), correlation("rs", "rt").alias("rank_ic"), F.when(enough, mean(10) - mean(1)).alias("decile_spread"))


def symbol_examples(raw: DataFrame, residual: DataFrame) -> DataFrame:
    """Per stock: standard deviation and mean before and after, and their correlation."""
    df = raw.select(*KEYS, finite(F.col("value")).alias("a")).join(residual.select(*KEYS, finite(F.col("residual")).alias("b")), KEYS).where("a is not null and b is not null")
    return df.groupBy("stock_code").agg(F.count("*").alias("n_obs"), F.stddev_pop("a").alias("raw_std"), F.stddev_pop("b").alias("residual_std"), F.avg("a").alias("raw_mean"), F.avg("b").alias("residual_mean"), correlation("a", "b").alias("correlation"))
