"""Return adjustment by price adjustment factors between buy and sell date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import finite


@dataclass(frozen=True)
class AdjustmentConfig:
    """``suspicious``: keep_raw or null what a factor does that soon reverses."""

    suspicious: str = "keep_raw"
    no_change: float = 1e-12
    jump: float = 0.02
    large_jump: float = 0.20
    window: int = 10
    tolerance: float = 0.02
    reversal_jump: float = 0.20


def trade_dates(calendar: DataFrame) -> DataFrame:
    """For each trading day as signal date: the next one (buy) and the one after it (sell).

    The calendar is one row per day, so ordering it whole is cheap.
    """
    w = Window.orderBy("date")
    return calendar.select("date").distinct().select("date", F.lead("date", 1).over(w).alias("buy_date"), F.lead("date", 2).over(w).alias("sell_date"))


def last_by(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of the largest ``ordinal`` per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _near(levels: Column, target: Column, tolerance: float) -> Column:
    return F.exists(levels, lambda v: v.isNotNull() & (v != 0) & (F.abs(F.try_divide(v, target) - 1) <= tolerance))


def adjust_returns(returns: DataFrame, factors: DataFrame, calendar: DataFrame, config: AdjustmentConfig | None = None) -> DataFrame:
    """(1 + r) f_sell / f_buy - 1 for every finite return of (date, stock_code, value).

    ``factors`` is (date, stock_code, factor), one row per key. Missing dates or factors give null, a ratio of
    1 keeps the return, and a large jump that nearby factors reverse is kept raw or dropped. Adds what was done and why.
    """
    c = config or AdjustmentConfig()
    w = Window.partitionBy("stock_code").orderBy("date")
    levels = factors.select(
        "stock_code",
        "date",
        finite(F.col("factor")).alias("f"),
        F.collect_list(finite(F.col("factor"))).over(w.rowsBetween(-c.window, -1)).alias("before"),
        F.collect_list(finite(F.col("factor"))).over(w.rowsBetween(1, c.window)).alias("after"),
    )
    side = lambda d, near: levels.select("stock_code", F.col("date").alias(d), F.col("f").alias(f"factor_{d[:-5]}"), F.col(near).alias(f"_{near}"))
    df = returns.select(F.col("date").alias("signal_date"), "stock_code", finite(F.col("value")).alias("return_raw")).where("return_raw is not null")
    df = df.join(F.broadcast(trade_dates(calendar)).withColumnRenamed("date", "signal_date"), "signal_date", "left")  # a row per day
    df = df.join(side("buy_date", "before"), ["stock_code", "buy_date"], "left").join(side("sell_date", "after"), ["stock_code", "sell_date"], "left")
    raw, buy, sell = F.col("return_raw"), F.col("factor_buy"), F.col("factor_sell")
    no_date = F.col("buy_date").isNull() | F.col("sell_date").isNull()
    no_factor = buy.isNull() | sell.isNull()
    invalid = (buy <= 0) | (sell <= 0)
    df = df.withColumn("factor_ratio", F.when(~no_date & ~no_factor & ~invalid, F.try_divide(sell, buy)))
    ratio = F.col("factor_ratio")
    df = df.withColumn("candidate", (1 + raw) * ratio - 1)
    turn = F.abs(ratio - 1)
    reverses = (turn > c.large_jump) & (turn > c.reversal_jump) & (_near(F.col("_before"), sell, c.tolerance) | _near(F.col("_after"), buy, c.tolerance))
    df = df.withColumn("jump_flag", F.coalesce(turn > c.jump, F.lit(False))).withColumn("large_jump_flag", F.coalesce(turn > c.large_jump, F.lit(False))).withColumn("suspicious_flag", F.coalesce(reverses, F.lit(False)))
    same = turn <= c.no_change
    # The names of actions and reasons.
    cases = [
        (no_date, None, "nan_missing_trade_date", "buy_date_or_sell_date_missing_from_trading_calendar"),
        (no_factor, None, "nan_missing_factor", "factor_buy_or_factor_sell_missing"),
        (invalid, None, "nan_invalid_factor", "factor_buy_or_factor_sell_is_non_positive_or_non_finite"),
        (same, raw, "unchanged_no_factor_change", "factor_ratio_is_one"),
        (F.col("suspicious_flag"), raw if c.suspicious == "keep_raw" else None, "kept_raw_suspicious_factor_reversal" if c.suspicious == "keep_raw" else "nan_suspicious_factor_reversal", "large_factor_jump_reverses_within_nearby_window"),
        (F.lit(True), F.col("candidate"), "adjusted_by_factor_ratio", "applied_factor_sell_over_factor_buy"),
    ]
    pick = lambda k: F.coalesce(*[F.when(x[0], F.struct(F.lit(x[1]).cast("double").alias("v") if x[1] is None else x[1].alias("v"), F.lit(x[2]).alias("a"), F.lit(x[3]).alias("r"))) for x in cases])[k]
    return df.select(
        "signal_date", "stock_code", "buy_date", "sell_date", "return_raw", "factor_buy", "factor_sell", "factor_ratio", "candidate",
        pick("v").alias("return_adjusted"), "jump_flag", "large_jump_flag", "suspicious_flag", pick("a").alias("action"), pick("r").alias("reason"),
    )


def action_counts(adjusted: DataFrame) -> DataFrame:
    big = lambda c: F.count_if(F.abs(F.col(c)) > 0.5)
    return adjusted.groupBy("action").agg(F.count("*").alias("rows"), big("return_raw").alias("over_half_raw"), big("return_adjusted").alias("over_half_adjusted"))


def rolling_liquidity(daily: DataFrame, rows: int = 20, least: int = 5) -> DataFrame:
    """Trailing means over ``rows`` rows per stock of positive amounts and volumes and non-negative turnover,
    null below ``least`` valid values; logAmount20 and logADV20 are log1p of the first two."""
    w = Window.partitionBy("stock_code").orderBy("date").rowsBetween(1 - rows, 0)

    def mean(x: Column) -> Column:
        return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))

    amount, volume, turnover = (finite(F.col(c)) for c in ("amount_k", "volume", "turnover"))
    df = daily.withColumn("amount20", mean(F.when(amount > 0, amount))).withColumn("adv20", mean(F.when(volume > 0, volume))).withColumn("turnover20", mean(F.when(turnover >= 0, turnover)))
    return df.withColumn("logAmount20", F.log1p("amount20")).withColumn("logADV20", F.log1p("adv20"))
