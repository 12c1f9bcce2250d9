"""Quality tools for return matrices: profile, horizon inference, extreme cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import finite
from ..functions.quantiles import exact_quantiles
from ..functions.stats import QUANTILES, distribution, moments

PROFILE_QUANTILES = (0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999)


def profile(returns: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row: counts, exact quantiles and threshold counts of (date, stock_code, value).

    ``returns`` may hold missing values; with a dense matrix in long form ``missing`` counts its empty cells.
    """
    x = finite(F.col("value"))
    a = F.abs(x)
    named = {"over_20pct": a > 0.2, "over_50pct": a > 0.5, "over_100pct": a > 1.0, "above_10pct": x > 0.1, "below_minus_10pct": x < -0.1, "zero": x == 0, "positive": x > 0, "negative": x < 0}
    counts = returns.agg(
        F.countDistinct("date").alias("dates"),
        F.countDistinct("stock_code").alias("stocks"),
        F.count("*").alias("cells"),
        F.count_if(x.isNull()).alias("missing"),
        *moments(x),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()],
    )
    ranks = exact_quantiles(returns.select(F.lit(1).alias("_one"), x.alias("_x")), "_one", "_x", PROFILE_QUANTILES)
    return counts.withColumn("_one", F.lit(1)).join(ranks, "_one", "left").drop("_one")  # one row each


def coverage(returns: DataFrame, by: str) -> DataFrame:
    """Cells, values, share of values and their mean and sample deviation per date or stock."""
    x = finite(F.col("value"))
    n = F.count("*")
    return returns.groupBy(by).agg(n.alias("cells"), F.count(x).alias("valid"), (F.count(x) / n).alias("coverage"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("std"))


def lowest_coverage(returns: DataFrame, by: str, n: int = 20) -> DataFrame:
    return coverage(returns, by).orderBy("valid", by).limit(n)


def annual_profile(returns: DataFrame) -> DataFrame:
    x = finite(F.col("value"))
    return returns.where(x.isNotNull()).groupBy(F.year("date").alias("year")).agg(F.count(x).alias("valid"), *[F.round(f(x), 6).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def top_extremes(returns: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` values of largest magnitude."""
    df = returns.select("date", "stock_code", finite(F.col("value")).alias("value")).where("value is not null")
    return df.orderBy(F.abs(F.col("value")).desc(), "date", "stock_code").limit(n)


def prefix_counts(codes: DataFrame, n: int = 20) -> DataFrame:
    return codes.select(F.substring("stock_code", 1, 3).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("stocks")).orderBy(F.desc("stocks"), "prefix").limit(n)


def malformed_codes(codes: DataFrame) -> DataFrame:
    return codes.where(~F.col("stock_code").rlike("^[0-9]{6}$")).select("stock_code").distinct()


def distribution_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distribution of each column: one row per column."""
    long = df.unpivot([], columns, "column", "v").withColumn("v", finite(F.col("v")))
    return long.groupBy("column").agg(*moments(F.col("v"))).join(exact_quantiles(long, "column", "v", QUANTILES), "column", "left")


def daily_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per date and column: the same statistics; compares values before and after a transform."""
    long = df.unpivot(["date"], columns, "column", "v").withColumn("v", finite(F.col("v")))
    return long.groupBy("date", "column").agg(*distribution(F.col("v"), (0.01, 0.05, 0.5, 0.95, 0.99)))


def horizon_errors(returns: DataFrame, closes: DataFrame, longest: int = 30, sample: int | None = 400, basis: float = 1e-4) -> DataFrame:
    """How well the h-row close return explains the values, for h of 1 to ``longest``.

    ``sample`` values are chosen by hash (None: all), so reruns agree. One row per horizon: n, median, p90
    and p99 of the absolute error, and how many are within ``basis``.
    """
    df = returns.select("date", "stock_code", finite(F.col("value")).alias("value")).where("value is not null")
    if sample is not None:
        df = df.orderBy(F.xxhash64("stock_code", "date"), "stock_code", "date").limit(sample)
    w = Window.partitionBy("stock_code").orderBy("date")
    close = finite(F.col("close"))
    ahead = F.array(*[F.lead(close, h).over(w) for h in range(1, longest + 1)])
    prices = closes.select("stock_code", "date", close.alias("_close"), ahead.alias("_ahead"))
    both = df.join(prices, ["stock_code", "date"]).select("value", "_close", F.posexplode("_ahead").alias("_h", "_later"))
    error = F.abs(F.try_divide(F.col("_later"), F.col("_close")) - 1 - F.col("value"))
    e = both.select((F.col("_h") + 1).alias("horizon"), error.alias("e")).where("e is not null")
    hit = F.count_if(F.col("e") < basis)
    counts = e.groupBy("horizon").agg(F.count("*").alias("n"), hit.alias("within_basis"), (hit / F.count("*")).alias("within_basis_rate"))
    ranks = exact_quantiles(e, "horizon", "e", (0.5, 0.9, 0.99)).select("horizon", *[F.col(p).alias(f"{n}_error") for p, n in (("p50", "median"), ("p90", "p90"), ("p99", "p99"))])
    return counts.join(ranks, "horizon")


def best_horizon(errors: DataFrame) -> DataFrame:
    return errors.orderBy("median_error", "p90_error", "horizon").limit(1)


def extreme_evidence(returns: DataFrame, history: DataFrame, calendar: DataFrame, stocks: DataFrame, threshold: float = 0.5, event_window: int = 5) -> DataFrame:
    """Extreme values with what trading history says about them.

    ``history`` is (stock_code, date, close, pct_change), ``stocks`` (stock_code, listing_date, delist_date). The event
    is the row of the largest close return among the first row not before the label date and the ``event_window`` rows after it.
    """
    cases = returns.select(F.col("date").alias("label_date"), "stock_code", finite(F.col("value")).alias("return_y")).where(F.abs(F.col("return_y")) > threshold)
    day = calendar.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("day_pos"))
    w = Window.partitionBy("stock_code").orderBy("date")
    close = finite(F.col("close"))
    h = history.join(stocks_of(cases), "stock_code", "left_semi").join(day, "date", "left")
    h = h.select(
        "stock_code",
        F.col("date").alias("d"),
        close.alias("close"),
        finite(F.col("pct_change")).alias("pct"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.try_divide(close, F.lag(close).over(w)).alias("_rel"),
        F.lag("date").over(w).alias("prev_date"),
        F.lead("date").over(w).alias("next_date"),
        F.greatest(F.col("day_pos") - F.lag("day_pos").over(w) - 1, F.lit(0)).alias("gap_before"),
        F.greatest(F.lead("day_pos").over(w) - F.col("day_pos") - 1, F.lit(0)).alias("gap_after"),
    ).withColumn("close_ret", F.col("_rel") - 1)
    # the rows before a label date are counted in one window over cases and history, so both joins are by equality
    seen = h.select("stock_code", F.col("d").alias("label_date"), F.lit(1).alias("_row")).unionByName(cases.select("stock_code", "label_date", F.lit(0).alias("_row")))
    before = F.sum("_row").over(Window.partitionBy("stock_code").orderBy("label_date", "_row").rowsBetween(Window.unboundedPreceding, 0))
    starts = seen.withColumn("base_pos", before).where("_row = 0").select("stock_code", "label_date", "base_pos", F.explode(F.sequence(F.col("base_pos"), F.col("base_pos") + event_window)).alias("pos"))
    near = starts.join(h.withColumn("pos", F.col("pos").cast("long")), ["stock_code", "pos"])
    at_base = lambda c: F.first(F.when(F.col("pos") == F.col("base_pos"), F.col(c)), True)
    event = near.groupBy("label_date", "stock_code").agg(
        at_base("d").alias("base_date"),
        at_base("close").alias("base_close"),
        F.max(F.struct(F.coalesce(F.abs(F.col("close_ret")), F.lit(-1.0)).alias("size"), (-F.col("pos")).alias("first"), F.col("d").alias("event_date"), F.col("close").alias("event_close"), "pct", "close_ret", "pos", "prev_date", "next_date", "gap_before", "gap_after")).alias("e"),
    )
    event = event.select("label_date", "stock_code", "base_date", "base_close", "e.event_date", "e.event_close", F.col("e.pct").alias("event_pct"), F.col("e.close_ret").alias("event_close_ret"), F.col("e.pos").alias("rows_since_first"), "e.prev_date", "e.next_date", "e.gap_before", "e.gap_after")
    known = history.select("stock_code").distinct().withColumn("has_history", F.lit(True))
    df = cases.join(event, ["label_date", "stock_code"], "left").join(known, "stock_code", "left").join(stocks.select("stock_code", "listing_date", "delist_date"), "stock_code", "left")
    cum = F.when(F.col("base_close") != 0, F.col("event_close") / F.col("base_close") - 1)
    df = df.withColumn("cum_ret", cum).withColumn("has_history", F.coalesce("has_history", F.lit(False))).withColumn("has_record", F.col("base_date").isNotNull())
    match = lambda c: F.coalesce(F.abs(c - F.col("return_y")) < 0.02, F.lit(False))
    return df.withColumn("move_matches_label", match(F.col("event_pct") / 100) | match(F.col("cum_ret"))).withColumn("days_to_listing", F.when(F.col("label_date") < F.col("listing_date"), F.datediff("listing_date", "label_date")))


def stocks_of(cases: DataFrame) -> DataFrame:
    return cases.select("stock_code").distinct()


# Names of the causes.
NEW, RECENT, SHIFTED = "new_listing_first_days", "recent_listing_first_60_trading_days", "label_shifted_before_listing_event"
DELIST, LONG_STOP, SHORT_STOP = "delisting_period_or_pre_delisting_trade", "resumption_after_long_suspension", "resumption_after_short_suspension"
RIGHTS, JUMP_50, JUMP_20, MATCH = "unadjusted_price_discontinuity_ex_rights_or_corporate_action", "single_day_raw_price_jump_over_50pct", "single_day_raw_price_jump_20_to_50pct", "label_matches_local_raw_move"


def _flags() -> Column:
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    to_delist = F.datediff("delist_date", "event_date")
    broken = yes(F.abs(c("event_close_ret")) >= 0.4) | yes(F.abs(c("cum_ret")) >= 0.4)
    pct = F.abs(c("event_pct"))
    steps = [
        F.when(c("rows_since_first") <= 5, NEW).when(c("rows_since_first") <= 60, RECENT),
        F.when(c("days_to_listing").between(1, 10), SHIFTED),
        F.when(to_delist.between(-5, 90), DELIST),
        F.when(c("gap_before") >= 20, LONG_STOP).when(c("gap_before") >= 5, SHORT_STOP),
        F.when(broken & (pct < 20), RIGHTS).when(pct >= 50, JUMP_50).when(pct >= 20, JUMP_20),
        F.when(c("move_matches_label"), MATCH),
    ]
    return F.array_compact(F.array(*steps))


def classify_extremes(evidence: DataFrame) -> DataFrame:
    """Adds flags (in order), primary_cause, severity and explanation."""
    df = evidence.withColumn("flags", _flags())
    has = lambda *names: F.arrays_overlap("flags", F.array(*[F.lit(n) for n in names]))
    rules = [
        (~F.col("has_history"), "missing_local_daily_history", "High"),
        (~F.col("has_record"), "pre_listing_or_no_trading_record_on_label_date", "High"),
        (F.size("flags") == 0, "unexplained_by_local_daily_metadata", "High"),
        (has(DELIST) & has(JUMP_50, LONG_STOP, SHORT_STOP), "delisting_or_resumption_extreme_trade", "High"),
        (has(NEW) & has(SHIFTED), "new_listing_label_shift", "Medium"),
        (has(NEW), NEW, "Medium"),
        (has(RIGHTS), "corporate_action_unadjusted_price_discontinuity", "High"),
        (has(LONG_STOP), LONG_STOP, "Medium"),
        (has(SHORT_STOP), SHORT_STOP, "Medium"),
        (has(JUMP_50), "large_raw_price_move", "Medium"),
    ]
    cause = F.coalesce(*[F.when(c, n) for c, n, _ in rules], F.get("flags", 0))
    severity = F.coalesce(*[F.when(c, s) for c, _, s in rules], F.lit("Medium"))
    differs = F.when(F.col("event_date") != F.col("label_date"), F.format_string("event on %s, label on %s", F.col("event_date").cast("string"), F.col("label_date").cast("string")))
    explanation = F.concat_ws("; ", F.col("flags"), differs)
    return df.withColumn("primary_cause", cause).withColumn("severity", severity).withColumn("explanation", explanation)


def cause_counts(classified: DataFrame) -> DataFrame:
    a = F.abs(F.col("return_y"))
    return classified.groupBy("primary_cause", "severity").agg(F.count("*").alias("cases"), F.avg(a).alias("mean_abs"), F.median(a).alias("median_abs"), F.max(a).alias("max_abs"))


def level_stats(df: DataFrame, columns: Sequence[str], thresholds: Sequence[float] = (0.1, 0.2, 0.5)) -> DataFrame:
    """Counts, moments, range and threshold counts of each column by date, by stock and over all rows, from one scan.

    ``level`` is date, stock or all; the keys that a level sums over are null.
    """
    x = {c: finite(F.col(f"`{c}`")) for c in columns}
    aggs = [a for c, v in x.items() for a in (*[m.alias(f"{c}_{n}") for m, n in zip(moments(v), ("count", "mean", "std", "min", "max"), strict=True)], *[F.count_if(F.abs(v) > t).alias(f"{c}_abs_gt_{t * 100:g}pct") for t in thresholds])]
    grouped = df.groupingSets([["date"], ["stock_code"], []], "date", "stock_code").agg(F.grouping_id().alias("_g"), *aggs)
    level = F.when(F.col("_g") == 1, "date").when(F.col("_g") == 2, "stock").otherwise("all")
    return grouped.select(level.alias("level"), "date", "stock_code", *[f"`{c}_{n}`" for c in columns for n in ("count", "mean", "std", "min", "max", *[f"abs_gt_{t * 100:g}pct" for t in thresholds])])
