"""Queries on scores: cross-sections, rank buckets, evaluation, periods, alignment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import forget, stored
from ..operators import diagnose, evaluate, nav, neutralize, panel, periods, quality, xsection
from . import market
from .registry import query

SCORES = ("pred_a", "pred_b")
BUCKETS = 5


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = market.panel(spark, sf_dir)
    return p, market.returns(p), market.predictions(p)


def _features(p: DataFrame) -> DataFrame:
    df = p.withColumn("log_mcap", F.log("market_cap")).withColumn("mcap_rank", xsection.centered_rank("market_cap")).withColumn("size_decile", xsection.decile("market_cap"))
    return xsection.add_robust_z(df, "log_mcap", "log_mcap_z")


# ---- shared expressions of the SQL

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fold_id, split, date ORDER BY pred_a DESC, stock_code) AS rank,
    count(*) OVER (PARTITION BY fold_id, split, date) AS eligible_count
  FROM predictions),
bucketed AS (SELECT *, ntile(5) OVER (PARTITION BY fold_id, split, date ORDER BY rank) AS bucket_index FROM ranked),
days AS (SELECT fold_id, split, date, count(*) AS n FROM ranked GROUP BY ALL),
frame AS (
  SELECT fold_id, split, date, n AS eligible_count, k AS bucket_index,
    (n // 5) * (k - 1) + least(k - 1, n % 5) + 1 AS rank_start, (n // 5) * k + least(k, n % 5) AS rank_end
  FROM days, range(1, 6) t(k)),
daily AS (
  SELECT f.fold_id, f.split, f.bucket_index, printf('bucket_%02d', f.bucket_index) AS bucket_label, f.date, f.eligible_count, f.rank_start, f.rank_end,
    count(b.stock_code) AS selected_count, count(r.value) AS valid_return_count, count(b.stock_code) - count(r.value) AS missing_return_count, avg(r.value) AS bucket_return
  FROM frame f LEFT JOIN bucketed b USING (fold_id, split, date, bucket_index) LEFT JOIN returns r ON r.date = b.date AND r.stock_code = b.stock_code
  GROUP BY ALL),
nav AS (
  SELECT *, gross_nav / greatest(1.0, max(gross_nav) OVER (PARTITION BY fold_id, split, bucket_index ORDER BY date)) - 1 AS drawdown
  FROM (SELECT *, coalesce(bucket_return, 0.0) AS applied_return, bucket_return IS NULL AS nav_stale_flag,
    exp(sum(ln(1 + coalesce(bucket_return, 0.0))) OVER (PARTITION BY fold_id, split, bucket_index ORDER BY date)) AS gross_nav FROM daily))
"""

SUMMARY = """min(date) AS start_date, max(date) AS end_date, count(*) AS day_count, count(bucket_return) AS valid_day_count,
  avg(bucket_return) AS mean_daily_return, stddev_pop(bucket_return) AS std_daily_return, arg_max(gross_nav, date) AS final_nav,
  pow(arg_max(gross_nav, date), 252.0 / count(*)) - 1 AS annualized_return,
  CASE WHEN count(bucket_return) >= 2 THEN stddev_pop(bucket_return) * sqrt(252) END AS annualized_vol,
  CASE WHEN count(bucket_return) >= 2 AND stddev_pop(bucket_return) > 1e-12 THEN avg(bucket_return) / stddev_pop(bucket_return) * sqrt(252) END AS sharpe,
  least(min(drawdown), 0.0) AS max_drawdown, avg(CASE WHEN bucket_return > 0 THEN 1.0 WHEN bucket_return IS NOT NULL THEN 0.0 END) AS positive_rate,
  avg(selected_count) AS mean_selected, avg(valid_return_count) AS mean_valid, min(valid_return_count) AS min_valid, CAST(sum(missing_return_count) AS BIGINT) AS missing_sum"""
SUMMARY_DOUBLES = "mean_daily_return std_daily_return final_nav annualized_return annualized_vol sharpe max_drawdown positive_rate mean_selected mean_valid"


def _underwater(keys: str, source: str) -> str:
    return f"""
    under AS (
      SELECT {keys}, max(n) AS longest_underwater_days FROM (
        SELECT {keys}, island, CAST(sum(CASE WHEN at_high THEN 0 ELSE 1 END) AS BIGINT) AS n FROM (
          SELECT *, sum(CAST(at_high AS INT)) OVER (PARTITION BY {keys} ORDER BY date) AS island FROM (
            SELECT *, gross_nav >= greatest(1.0, coalesce(max(gross_nav) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0)) AS at_high
            FROM {source})) GROUP BY ALL) GROUP BY ALL)"""


PAIRS = """
pairs AS (
  SELECT fold_id, split, date, stock_code, score_col, score, value AS target
  FROM (SELECT fold_id, split, date, stock_code, 'pred_a' AS score_col, pred_a AS score FROM predictions UNION ALL SELECT fold_id, split, date, stock_code, 'pred_b', pred_b FROM predictions)
  JOIN returns USING (date, stock_code) WHERE score IS NOT NULL AND value IS NOT NULL),
pair_ranks AS (
  SELECT *, rank() OVER (PARTITION BY fold_id, split, date, score_col ORDER BY score) + (count(*) OVER (PARTITION BY fold_id, split, date, score_col, score) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY fold_id, split, date, score_col ORDER BY target) + (count(*) OVER (PARTITION BY fold_id, split, date, score_col, target) - 1) / 2.0 AS rt FROM pairs)
"""


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


IC = f"{PAIRS.rstrip()}, ic AS (SELECT fold_id, split, date, score_col, count(*) AS n_obs, {_corr('score', 'target')} AS ic, {_corr('rs', 'rt')} AS rank_ic FROM pair_ranks GROUP BY ALL)"


def _ratio(x: str) -> str:
    return f"CASE WHEN count({x}) >= 2 AND stddev_pop({x}) > 1e-12 THEN avg({x}) / stddev_pop({x}) * sqrt(252) END"


def _rate(x: str) -> str:
    return f"avg(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END)"


IC_SUMMARY = f"""count(*) AS date_count, CAST(sum(n_obs) AS BIGINT) AS total_obs, count(ic) AS valid_ic_count, avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, {_ratio("ic")} AS ic_ir, {_rate("ic")} AS ic_positive_rate,
  avg(rank_ic) AS mean_rank_ic, stddev_pop(rank_ic) AS std_rank_ic, {_ratio("rank_ic")} AS rank_ic_ir, {_rate("rank_ic")} AS rank_ic_positive_rate"""
IC_DOUBLES = "mean_ic std_ic ic_ir ic_positive_rate mean_rank_ic std_rank_ic rank_ic_ir rank_ic_positive_rate"


# ---- rank buckets

@query("SELECT * FROM nav", "bucket_return applied_return gross_nav drawdown", RANKED)
def rank_bucket_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, pred = _market(spark, sf_dir)
    return nav.rank_bucket_nav(pred, r, "pred_a", bucket_count=BUCKETS)["nav"]


@query("SELECT * FROM daily", "bucket_return", RANKED)
def rank_bucket_daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, pred = _market(spark, sf_dir)
    return nav.bucket_returns(nav.rank_scores(pred, "pred_a"), r, BUCKETS)


@query(
    """SELECT d.fold_id, d.split, s.i AS bucket_index, s.label AS bucket_label, d.date, d.n AS eligible_count, s.lo AS rank_start, s.hi AS rank_end, count(k.stock_code) AS selected_count,
      count(r.value) AS valid_return_count, count(k.stock_code) - count(r.value) AS missing_return_count, CASE WHEN count(r.value) >= 2 THEN avg(r.value) END AS bucket_return
    FROM days d CROSS JOIN (VALUES (1::BIGINT, 'top', 1::BIGINT, 10::BIGINT), (2, 'next', 11, 30), (3, 'rest', 31, 90)) s(i, label, lo, hi)
    LEFT JOIN ranked k ON k.fold_id = d.fold_id AND k.split = d.split AND k.date = d.date AND k.rank BETWEEN s.lo AND s.hi
    LEFT JOIN returns r ON r.date = k.date AND r.stock_code = k.stock_code GROUP BY ALL""",
    "bucket_return",
    RANKED,
)
def fixed_rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, pred = _market(spark, sf_dir)
    fixed = [nav.parse_rank_bucket(t) for t in ("1:10=top", "11:30=next", "31:90=rest")]
    return nav.bucket_returns(nav.rank_scores(pred, "pred_a"), r, buckets=fixed, min_names=2)


@query(
    f"SELECT * FROM (SELECT fold_id, split, bucket_index, bucket_label, {SUMMARY} FROM nav GROUP BY ALL) JOIN under USING (fold_id, split, bucket_index, bucket_label)",
    SUMMARY_DOUBLES,
    f"{RANKED.rstrip()},{_underwater('fold_id, split, bucket_index, bucket_label', 'nav')}",
    6,
)
def bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, pred = _market(spark, sf_dir)
    return nav.rank_bucket_nav(pred, r, "pred_a", bucket_count=BUCKETS)["summary"]


CATEGORY = """
universe AS (SELECT fold_id, split, date, industry, count(*) / sum(count(*)) OVER (PARTITION BY fold_id, split, date) AS universe_weight FROM ranked JOIN panel USING (date, stock_code) GROUP BY fold_id, split, date, industry),
own AS (SELECT fold_id, split, date, bucket_index, industry, count(*) / sum(count(*)) OVER (PARTITION BY fold_id, split, date, bucket_index) AS bucket_weight FROM bucketed JOIN panel USING (date, stock_code) GROUP BY fold_id, split, date, bucket_index, industry),
composition AS (
  SELECT fold_id, split, date, bucket_index, bucket_label, industry, universe_weight, coalesce(bucket_weight, 0.0) AS bucket_weight, coalesce(bucket_weight, 0.0) - universe_weight AS active_weight
  FROM (SELECT DISTINCT fold_id, split, date, bucket_index, printf('bucket_%02d', bucket_index) AS bucket_label FROM bucketed) JOIN universe USING (fold_id, split, date) LEFT JOIN own USING (fold_id, split, date, bucket_index, industry))
"""


def _composition(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, _, pred = _market(spark, sf_dir)
    ranked = nav.attach_features(nav.rank_scores(pred, "pred_a"), _features(p), ["industry", *nav.SIZE_METRICS])
    return nav.assign_buckets(ranked, BUCKETS), ranked


@query("SELECT * FROM composition", "universe_weight bucket_weight active_weight", f"{RANKED.rstrip()},{CATEGORY}")
def industry_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed, ranked = _composition(spark, sf_dir)
    return nav.category_composition(bucketed, ranked, "industry")


@query(
    f"""SELECT fold_id, split, bucket_index, bucket_label, industry, count(*) AS day_count, avg(bucket_weight) AS mean_bucket, avg(universe_weight) AS mean_universe, avg(active_weight) AS mean_active, stddev_pop(active_weight) AS std_active,
      CASE WHEN count(*) >= 2 AND stddev_pop(active_weight) > 1e-12 THEN avg(active_weight) * sqrt(count(*)) / stddev_pop(active_weight) END AS t_active, {_rate("active_weight")} AS positive_rate FROM composition GROUP BY ALL""",
    "mean_bucket mean_universe mean_active std_active t_active positive_rate",
    f"{RANKED.rstrip()},{CATEGORY}",
    6,
)
def industry_composition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed, ranked = _composition(spark, sf_dir)
    return nav.summarize_composition(nav.category_composition(bucketed, ranked, "industry"), "industry")


FEATURES = """
ranks AS (SELECT *, ln(market_cap) AS log_mcap, rank() OVER w AS rk, count(*) OVER (PARTITION BY date, market_cap) AS ties, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY market_cap, stock_code) AS rn FROM panel WINDOW w AS (PARTITION BY date ORDER BY market_cap)),
clipped AS (SELECT *, least(greatest(log_mcap, quantile_cont(log_mcap, 0.01) OVER (PARTITION BY date)), quantile_cont(log_mcap, 0.99) OVER (PARTITION BY date)) AS x FROM ranks),
centred AS (SELECT *, median(x) OVER (PARTITION BY date) AS m, stddev_pop(x) OVER (PARTITION BY date) AS sd FROM clipped),
scaled AS (SELECT *, 1.4826 * median(abs(x - m)) OVER (PARTITION BY date) AS mad FROM centred),
features AS (
  SELECT * EXCLUDE (rk, ties, n, rn, x, m, sd, mad), (rk + (ties - 1) / 2.0 - 0.5) / n - 0.5 AS mcap_rank, CAST(ceil(10.0 * rn / n) - 1 AS BIGINT) AS size_decile,
    least(greatest((x - m) / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1.0 END, -5.0), 5.0) AS log_mcap_z FROM scaled)
"""


@query(
    """SELECT fold_id, split, date, bucket_index, bucket_label, metric, o.v AS bucket_value, u.v AS universe_value, o.v - u.v AS active_value FROM
      (UNPIVOT (SELECT fold_id, split, date, bucket_index, printf('bucket_%02d', bucket_index) AS bucket_label, avg(log_mcap) AS log_mcap, avg(log_mcap_z) AS log_mcap_z, avg(mcap_rank) AS mcap_rank, avg(size_decile) AS size_decile FROM bucketed JOIN features USING (date, stock_code) GROUP BY ALL) ON log_mcap, log_mcap_z, mcap_rank, size_decile INTO NAME metric VALUE v) o
    JOIN (UNPIVOT (SELECT fold_id, split, date, avg(log_mcap) AS log_mcap, avg(log_mcap_z) AS log_mcap_z, avg(mcap_rank) AS mcap_rank, avg(size_decile) AS size_decile FROM ranked JOIN features USING (date, stock_code) GROUP BY ALL) ON log_mcap, log_mcap_z, mcap_rank, size_decile INTO NAME metric VALUE v) u USING (fold_id, split, date, metric)""",
    "bucket_value universe_value active_value",
    f"{RANKED.rstrip()},{FEATURES}",
    6,
)
def size_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed, ranked = _composition(spark, sf_dir)
    return nav.size_composition(bucketed, ranked, ("log_mcap", "log_mcap_z", "mcap_rank", "size_decile"))


@query(
    """SELECT fold_id, split, bucket_index, printf('bucket_%02d', bucket_index) AS bucket_label, date, stock_code, rank, row_number() OVER (PARTITION BY fold_id, split, date, bucket_index ORDER BY rank) AS rank_in_bucket,
      1.0 / count(*) OVER (PARTITION BY fold_id, split, date, bucket_index) AS weight FROM bucketed""",
    "weight",
    RANKED,
)
def bucket_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pred = _market(spark, sf_dir)
    return nav.constituents(nav.assign_buckets(nav.rank_scores(pred, "pred_a"), BUCKETS))


# ---- cross-sections

@query("SELECT date, stock_code, mcap_rank, size_decile, log_mcap_z FROM features", "mcap_rank log_mcap_z", FEATURES)
def centered_rank_decile_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(market.panel(spark, sf_dir)).select("date", "stock_code", "mcap_rank", "size_decile", "log_mcap_z")


@query(
    """SELECT fold_id, split, date, stock_code, coalesce(CASE WHEN mad > 1e-12 AND pred_b IS NOT NULL THEN least(greatest((pred_b - m) / mad, -5.0), 5.0) END, 0.0) AS z FROM (
      SELECT *, 1.4826 * median(abs(pred_b - m)) OVER (PARTITION BY fold_id, split, date) AS mad FROM (SELECT *, median(pred_b) OVER (PARTITION BY fold_id, split, date) AS m FROM predictions))""",
    "z",
)
def score_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pred = _market(spark, sf_dir)
    return xsection.add_score_z(pred, "pred_b", "z").select("fold_id", "split", "date", "stock_code", "z")


# ---- evaluation

def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, pred = _market(spark, sf_dir)
    return evaluate.evaluation_frame(pred, p.join(r, ["date", "stock_code"]), ["value", "industry", "board", "volume", "turnover"])


@query("SELECT * FROM ic", "ic rank_ic", IC)
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.daily_ic(_frame(spark, sf_dir), SCORES, "value")


@query(f"SELECT fold_id, split, score_col, {IC_SUMMARY} FROM ic GROUP BY ALL", IC_DOUBLES, IC, 6)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize_ic(evaluate.daily_ic(_frame(spark, sf_dir), SCORES, "value"))


SPREAD = f"""{PAIRS.rstrip()},
positions AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY fold_id, split, date, score_col ORDER BY score, stock_code) AS rn, min(score) OVER g < max(score) OVER g AS varied FROM pairs WINDOW g AS (PARTITION BY fold_id, split, date, score_col)),
quantiles AS (SELECT *, least(10, n) AS top, greatest(ceil((rn - 1) * least(10, n) / (n - 1)), 1) AS q FROM positions WHERE varied AND n >= 2),
spread AS (SELECT fold_id, split, date, score_col, avg(target) FILTER (q = top) AS top_mean, avg(target) FILTER (q = 1) AS bottom_mean, count(*) FILTER (q = top) AS top_count, count(*) FILTER (q = 1) AS bottom_count, avg(target) FILTER (q = top) - avg(target) FILTER (q = 1) AS spread FROM quantiles GROUP BY ALL)"""


@query("SELECT * FROM spread", "top_mean bottom_mean spread", SPREAD)
def top_bottom_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_bottom_spread(_frame(spark, sf_dir), SCORES, "value")


@query(f"SELECT fold_id, split, score_col, count(*) AS date_count, avg(top_mean) AS mean_top, avg(bottom_mean) AS mean_bottom, avg(spread) AS mean_spread, stddev_pop(spread) AS std_spread, {_ratio('spread')} AS spread_ir, {_rate('spread')} AS positive_rate FROM spread GROUP BY ALL", "mean_top mean_bottom mean_spread std_spread spread_ir positive_rate", SPREAD, 6)
def spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize_spread(evaluate.top_bottom_spread(_frame(spark, sf_dir), SCORES, "value"))


TERCILES = """
conditions AS (
  SELECT p.fold_id, p.split, p.date, p.stock_code, c.industry, c.board, p.pred_a, r.value, CASE WHEN n >= 2 THEN CASE WHEN n >= 3 THEN (['low', 'mid', 'high'])[CAST(k AS INT)] ELSE printf('q%d', CAST(k AS INT)) END END AS volume_bucket FROM (
    SELECT *, greatest(ceil((rn - 1) * least(3, n) / nullif(n - 1, 0)), 1) AS k FROM (
      SELECT p.*, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY volume, stock_code, fold_id, split) AS rn FROM predictions p JOIN panel USING (date, stock_code))) p
  JOIN panel c USING (date, stock_code) LEFT JOIN returns r USING (date, stock_code))
"""


@query("SELECT fold_id, split, date, stock_code, volume_bucket FROM conditions", "", TERCILES)
def condition_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.add_condition_buckets(_frame(spark, sf_dir), {"volume_bucket": "volume"})
    return df.select("fold_id", "split", "date", "stock_code", "volume_bucket")


@query(
    f"""SELECT * FROM (SELECT fold_id, split, date, 'pred_a' AS score_col, dimension, grp AS "group", count(*) AS n_obs, {_corr("pred_a", "value")} AS ic, {_corr("rs", "rt")} AS rank_ic FROM (
      SELECT *, rank() OVER (PARTITION BY fold_id, split, date, dimension, grp ORDER BY pred_a) + (count(*) OVER (PARTITION BY fold_id, split, date, dimension, grp, pred_a) - 1) / 2.0 AS rs,
        rank() OVER (PARTITION BY fold_id, split, date, dimension, grp ORDER BY value) + (count(*) OVER (PARTITION BY fold_id, split, date, dimension, grp, value) - 1) / 2.0 AS rt FROM (
          SELECT fold_id, split, date, stock_code, pred_a, value, unnest(['board', 'volume_bucket']) AS dimension, unnest([board, volume_bucket]) AS grp FROM conditions) WHERE grp IS NOT NULL AND value IS NOT NULL AND pred_a IS NOT NULL)
      GROUP BY ALL) WHERE n_obs >= 5 AND (ic IS NOT NULL OR rank_ic IS NOT NULL)""",
    "ic rank_ic",
    TERCILES,
)
def group_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.add_condition_buckets(_frame(spark, sf_dir), {"volume_bucket": "volume"})
    return evaluate.group_ic(df, ["pred_a"], "value", ["board", "volume_bucket"], 5)


DISCOVERED = """
held AS (
  SELECT p.fold_id, p.split, p.date, p.stock_code, c.industry, c.board, p.pred_a, p.pred_b, r.value, CASE WHEN n >= 2 THEN CASE WHEN n >= 3 THEN (['low', 'mid', 'high'])[CAST(k AS INT)] ELSE printf('q%d', CAST(k AS INT)) END END AS mcap_tercile FROM (
    SELECT *, greatest(ceil((rn - 1) * least(3, n) / nullif(n - 1, 0)), 1) AS k FROM (
      SELECT p.*, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY market_cap, stock_code, fold_id, split) AS rn FROM predictions p JOIN panel USING (date, stock_code))) p
  JOIN panel c USING (date, stock_code) LEFT JOIN returns r USING (date, stock_code))"""


@query(
    f"""SELECT * FROM (SELECT fold_id, split, date, 'pred_a' AS score_col, dimension, grp AS "group", count(*) AS n_obs, {_corr("pred_a", "value")} AS ic, {_corr("rs", "rt")} AS rank_ic FROM (
      SELECT *, rank() OVER (PARTITION BY fold_id, split, date, dimension, grp ORDER BY pred_a) + (count(*) OVER (PARTITION BY fold_id, split, date, dimension, grp, pred_a) - 1) / 2.0 AS rs,
        rank() OVER (PARTITION BY fold_id, split, date, dimension, grp ORDER BY value) + (count(*) OVER (PARTITION BY fold_id, split, date, dimension, grp, value) - 1) / 2.0 AS rt FROM (
          SELECT fold_id, split, date, stock_code, pred_a, value, unnest(['industry', 'board', 'mcap_tercile']) AS dimension, unnest([industry, board, mcap_tercile]) AS grp FROM held) WHERE grp IS NOT NULL AND value IS NOT NULL AND pred_a IS NOT NULL)
      GROUP BY ALL) WHERE n_obs >= 2 AND (ic IS NOT NULL OR rank_ic IS NOT NULL)""",
    "ic rank_ic",
    DISCOVERED,
)
def discovered_group_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group coefficients by the dimensions that the panel turns out to have; a column without values makes none."""
    p, r, pred = _market(spark, sf_dir)
    held = p.select("date", "stock_code", "industry", "board", "market_cap", F.lit(None).cast("double").alias("turnover20")).join(r, ["date", "stock_code"], "left")
    with_target = pred.join(r, ["date", "stock_code"], "left")
    return evaluate.evaluate_discovered(with_target, held.drop("value"), ["pred_a"], "value")["group_ic"]


@query(
    f"SELECT fold_id, split, score_col, count(ic) AS date_count, avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, avg(rank_ic) AS mean_rankic, stddev_pop(rank_ic) AS std_rankic FROM ic GROUP BY ALL",
    "mean_ic std_ic mean_rankic std_rankic",
    IC,
    6,
)
def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.prediction_metrics(_frame(spark, sf_dir), SCORES, "value")


GAINS = """
gains AS (
  SELECT CAST(s_nationkey % 4 AS BIGINT) AS fold_id, n_name AS feature, CAST(greatest(sum(CAST(s_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS importance_gain, CAST(count(*) AS DOUBLE) AS importance_split
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
shares AS (
  SELECT *, coalesce(importance_gain / nullif(sum(importance_gain) OVER f, 0), 0.0) AS gain_share, rank() OVER (PARTITION BY fold_id ORDER BY importance_gain DESC) AS gain_rank,
    coalesce(importance_split / nullif(sum(importance_split) OVER f, 0), 0.0) AS split_share, rank() OVER (PARTITION BY fold_id ORDER BY importance_split DESC) AS split_rank FROM gains WINDOW f AS (PARTITION BY fold_id))
"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = market.table(spark, sf_dir, "supplier").join(market.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    total = F.sum(F.col("s_acctbal").cast("decimal(18,2)"))
    return s.groupBy((F.col("s_nationkey") % 4).alias("fold_id"), F.col("n_name").alias("feature")).agg(F.greatest(total, F.lit(0)).cast("double").alias("importance_gain"), F.count("*").cast("double").alias("importance_split"))


@query("SELECT *, sum(gain_share) OVER (PARTITION BY fold_id ORDER BY importance_gain DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative_gain_share FROM shares", "importance_gain importance_split gain_share split_share cumulative_gain_share", GAINS, 6)
def feature_gain_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.feature_gain(_gains(spark, sf_dir))


@query(
    "SELECT feature, count(*) AS fold_count, avg(importance_gain) AS mean_gain, avg(gain_share) AS mean_gain_share, stddev_pop(gain_share) AS std_gain_share, avg(gain_rank) AS mean_gain_rank, count(*) FILTER (importance_gain > 0) AS nonzero_folds, avg(split_share) AS mean_split_share FROM shares GROUP BY ALL",
    "mean_gain mean_gain_share std_gain_share mean_gain_rank mean_split_share",
    GAINS,
    6,
)
def feature_gain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize_feature_gain(evaluate.feature_gain(_gains(spark, sf_dir)))


# ---- periods, alignment, stitching, comparison

WITHIN = f"""{RANKED.rstrip()},
within AS (SELECT period, n.* FROM nav n JOIN periods ON n.date BETWEEN lo AND hi WHERE n.split = 'test'),
period_nav AS (
  SELECT *, gross_nav / greatest(1.0, max(gross_nav) OVER (PARTITION BY period, bucket_index ORDER BY date)) - 1 AS drawdown FROM (
    SELECT * EXCLUDE (gross_nav, drawdown), exp(sum(ln(1 + applied_return)) OVER (PARTITION BY period, bucket_index ORDER BY date)) AS gross_nav FROM within)),{_underwater("period, bucket_index, bucket_label", "period_nav")}"""


@query(
    f"SELECT * FROM (SELECT period, bucket_index, bucket_label, {SUMMARY}, count(*) FILTER (nav_stale_flag) AS empty_day_count FROM period_nav GROUP BY ALL) JOIN under USING (period, bucket_index, bucket_label)",
    SUMMARY_DOUBLES,
    WITHIN,
    6,
)
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, pred = _market(spark, sf_dir)
    return periods.period_summary(nav.bucket_returns(nav.rank_scores(pred, "pred_a"), r, BUCKETS), market.PERIODS)


PREFERENCES = f"""{RANKED.rstrip()},{CATEGORY.rstrip()},
period_industry AS (SELECT period, bucket_index, bucket_label, industry, count(*) AS day_count, avg(active_weight) AS mean_active FROM composition c JOIN periods ON c.date BETWEEN lo AND hi WHERE split = 'test' GROUP BY ALL)"""


@query(
    """SELECT * FROM (
      SELECT *, 'overweight' AS side, row_number() OVER (PARTITION BY period, bucket_index ORDER BY round(mean_active, 10) DESC, industry) AS side_rank FROM period_industry WHERE bucket_index IN (1, 5) AND mean_active > 0
      UNION ALL SELECT *, 'underweight', row_number() OVER (PARTITION BY period, bucket_index ORDER BY round(mean_active, 10), industry) FROM period_industry WHERE bucket_index IN (1, 5) AND mean_active < 0) WHERE side_rank <= 3""",
    "mean_active",
    PREFERENCES,
    6,
)
def period_industry_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed, ranked = _composition(spark, sf_dir)
    summary = periods.period_industry_composition(nav.category_composition(bucketed, ranked, "industry"), market.PERIODS)
    # rounded first, so that equal means tie in any order of addition
    table = summary.select("period", "bucket_index", "bucket_label", "industry", "day_count", F.round("mean_active", 10).alias("mean_active"))
    return periods.top_industry_preferences(table, (1, BUCKETS), 3)


ALIGNMENT = f"""
joined AS (SELECT fold_id, split, date, stock_code, pred_b AS c, amount_k AS r FROM predictions JOIN panel USING (date, stock_code) WHERE split = 'test' AND pred_b IS NOT NULL),
tops AS (
  SELECT *, row_number() OVER (w ORDER BY c DESC, stock_code) <= ceil(count(*) OVER w / 5.0) AS top_c, row_number() OVER (w ORDER BY r DESC, stock_code) <= ceil(count(*) OVER w / 5.0) AS top_r,
    rank() OVER (w ORDER BY c) + (count(*) OVER (PARTITION BY fold_id, split, date, c) - 1) / 2.0 AS rc, rank() OVER (w ORDER BY r) + (count(*) OVER (PARTITION BY fold_id, split, date, r) - 1) / 2.0 AS rr FROM joined WINDOW w AS (PARTITION BY fold_id, split, date)),
alignment AS (
  SELECT *, top_overlap / top_count AS top_overlap_rate FROM (
    SELECT fold_id, split, date, count(*) AS n_obs, {_corr("rc", "rr")} AS spearman, count(*) FILTER (top_c) AS top_count, count(*) FILTER (top_c AND top_r) AS top_overlap FROM tops GROUP BY ALL))"""


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, pred = _market(spark, sf_dir)
    return periods.daily_alignment(p, pred, "amount_k", "pred_b", BUCKETS)


@query("SELECT * FROM alignment", "spearman top_overlap_rate", ALIGNMENT)
def rank_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment(spark, sf_dir)


@query("SELECT period, count(*) AS date_count, avg(spearman) AS mean_spearman, median(spearman) AS median_spearman, avg(top_overlap_rate) AS mean_overlap, median(top_overlap_rate) AS median_overlap FROM alignment JOIN periods ON date BETWEEN lo AND hi GROUP BY ALL", "mean_spearman median_spearman mean_overlap median_overlap", ALIGNMENT)
def period_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.period_alignment(_alignment(spark, sf_dir), market.PERIODS)


@query(
    """SELECT CAST(0 AS BIGINT) AS fold_id, 'test' AS split, date, stock_code, pred_a, fold_id AS source_fold_id, split AS source_split FROM predictions
    WHERE (fold_id = 1 AND split IN ('valid', 'test')) OR (fold_id > 1 AND split = 'test')""",
    "pred_a",
)
def chronological_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pred = _market(spark, sf_dir)
    ranges = {f.fold_id: f.ranges() for f in market.FOLDS}
    return periods.stitch(pred, [s for s in periods.source_segments(ranges) if s.split != "train"], "pred_a")


SIGNALS = {"alpha_value": "alpha", "amount": "amount_k", "liquidity": "turnover"}
COMPARED = f"""
long AS (SELECT fold_id, split, date, stock_code, unnest(['alpha_value', 'amount', 'liquidity']) AS signal_id, unnest([alpha, amount_k, turnover]) AS score FROM predictions JOIN panel USING (date, stock_code) WHERE split = 'test'),
tiles AS (SELECT *, ntile(5) OVER (PARTITION BY signal_id, fold_id, date ORDER BY score DESC, stock_code) AS bucket_index FROM long),
tile_returns AS (SELECT period, signal_id, bucket_index, printf('bucket_%02d', bucket_index) AS bucket_label, t.date, count(*) AS selected_count, count(value) AS valid_return_count, count(*) - count(value) AS missing_return_count, avg(value) AS bucket_return
  FROM tiles t JOIN periods p ON t.date BETWEEN lo AND hi LEFT JOIN returns r ON r.date = t.date AND r.stock_code = t.stock_code GROUP BY ALL),
signal_nav AS (
  SELECT *, gross_nav / greatest(1.0, max(gross_nav) OVER (PARTITION BY signal_id, period, bucket_index ORDER BY date)) - 1 AS drawdown FROM (
    SELECT *, exp(sum(ln(1 + coalesce(bucket_return, 0.0))) OVER (PARTITION BY signal_id, period, bucket_index ORDER BY date)) AS gross_nav FROM tile_returns)),{_underwater("signal_id, period, bucket_index, bucket_label", "signal_nav")}"""


@query(f"SELECT * EXCLUDE (annualized_return) FROM (SELECT signal_id, period, bucket_index, bucket_label, {SUMMARY} FROM signal_nav GROUP BY ALL) JOIN under USING (signal_id, period, bucket_index, bucket_label)", SUMMARY_DOUBLES.replace("annualized_return ", ""), COMPARED, 6)
def signal_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, pred = _market(spark, sf_dir)
    # twelve monthly returns compounded to a year of 252 are too large to compare digit by digit
    return periods.compare_signals(p, pred, r, SIGNALS, market.PERIODS, BUCKETS).drop("annualized_return")


# ---- regressions

def _projected(source: str, y: str, columns: list[str], tag: str) -> str:
    """SQL: ``tag`` has ``source`` with e, what is left of ``y`` by date after industries and then ``columns`` are taken off, each first freed of those before it, and rank."""
    centred = ", ".join(f"{c} - avg({c}) OVER i AS v{k}" for k, c in enumerate([y, *columns]))
    steps = [f"{tag}_0 AS (SELECT *, {centred} FROM {source} WINDOW i AS (PARTITION BY date, industry))"]
    for k in range(1, len(columns) + 1):
        left = [0, *range(k + 1, len(columns) + 1)]
        slopes = ", ".join(f"sum(v{k} * v{j}) / nullif(CASE WHEN sum(v{k} * v{k}) > 1e-9 THEN sum(v{k} * v{k}) END, 0) AS b{j}" for j in left)
        steps.append(f"{tag}_s{k} AS (SELECT date, {slopes}, CAST(sum(v{k} * v{k}) > 1e-9 AS INT) AS r{k} FROM {tag}_{k - 1} GROUP BY date)")
        taken = ", ".join(f"v{j} - coalesce(b{j}, 0) * v{k} AS v{j}" for j in left)
        steps.append(f"{tag}_{k} AS (SELECT t.* REPLACE ({taken}), r{k} FROM {tag}_{k - 1} t JOIN {tag}_s{k} USING (date))")
    ranks = " + ".join(f"r{k}" for k in range(1, len(columns) + 1))
    steps.append(f"{tag} AS (SELECT *, v0 AS e, {ranks} AS free FROM {tag}_{len(columns)})")
    return ",\n".join(steps)


@query()
def neutralize_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, _ = _market(spark, sf_dir)
    return neutralize.neutralize(r, p)


FLAGS = ["is_csi300", "is_csi500", "is_csi1000", "is_csi2000"]


def _exact_days() -> str:
    columns = [*FLAGS, "x"]
    names = ["is_csi300", "is_csi500", "is_csi1000", "is_csi2000", "size_rank_norm"]
    varied = [f"stddev_pop({c}) > 1e-12" for c in columns]
    used = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{n}' END" for v, n in zip(varied, names, strict=True)) + "], lambda n: n IS NOT NULL), ',')"
    return f"""
given AS (SELECT date, stock_code, industry, board, value AS y, market_cap, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FLAGS)} FROM returns JOIN panel USING (date, stock_code) WHERE value IS NOT NULL AND market_cap > 0),
sized AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY market_cap) + (count(*) OVER (PARTITION BY date, market_cap) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5 AS x FROM given),
designs AS (SELECT date, count(*) AS n, count(DISTINCT industry) + count(DISTINCT board) - 1 + {" + ".join(f"CAST({v} AS INT)" for v in varied)} AS k, {" + ".join(f"CAST(NOT ({v}) AS INT)" for v in varied)} AS dropped, {used} AS used FROM sized GROUP BY date),
{_projected("sized", "y", columns, "left_over")},
days_ AS (SELECT date, count(*) AS n_total, count(value) AS n_valid_return FROM returns GROUP BY date),
exposed AS (SELECT r.date, count(*) AS n_valid_exposure FROM returns r JOIN panel USING (date, stock_code) WHERE market_cap > 0 GROUP BY r.date),
told AS (SELECT date, avg(y) AS m, avg(e) AS em, stddev_pop(e) AS es, 1 - avg(e * e) / var_pop(y) AS r2 FROM left_over GROUP BY date),
reasons AS (SELECT *, coalesce(n, 0) AS n_used, CASE WHEN coalesce(n, 0) < 30 THEN 'too_few_valid_observations' WHEN n <= k + 10 THEN 'too_few_observations_for_design' END AS reason FROM days_ LEFT JOIN designs USING (date) LEFT JOIN exposed USING (date) LEFT JOIN told USING (date))"""


@query(
    """SELECT date, reason AS skipped_reason, n_used, CASE WHEN n_used >= 30 THEN k ELSE 0 END AS n_columns, n_total, n_valid_return, coalesce(n_valid_exposure, 0) AS n_valid_exposure, n_valid_return - n_used AS missing_exposure_count,
      CASE WHEN n_used >= 30 THEN dropped ELSE 0 END AS dropped_constant_continuous_count, reason IS NOT NULL AS skipped, CASE WHEN n_used >= 30 THEN used ELSE '' END AS continuous_columns_used, CASE WHEN reason IS NULL THEN 'lstsq' END AS method,
      CASE WHEN reason IS NULL THEN r2 END AS r2, CASE WHEN reason IS NULL THEN m END AS return_weighted_mean, CASE WHEN reason IS NULL THEN 0.0 END AS residual_weighted_mean, CASE WHEN reason IS NULL THEN es END AS residual_weighted_std,
      CASE WHEN reason IS NULL THEN 0.0 END AS max_abs_industry_mean_after, CASE WHEN reason IS NULL THEN 0.0 END AS max_abs_board_mean_after, CASE WHEN reason IS NULL THEN 0.0 END AS max_abs_continuous_exposure_after,
      'exact_neutralization' AS neutralization_type, 0.0 AS ridge, CAST(NULL AS DOUBLE) AS winsor_lower, CAST(NULL AS DOUBLE) AS winsor_upper FROM reasons""",
    "r2 return_weighted_mean residual_weighted_std",
    _exact_days(),
    6,
)
def neutralization_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, _ = _market(spark, sf_dir)
    return neutralize.neutralize_tables(r, p, neutralize.EXACT)["diagnostics"]


@query(
    """SELECT r.date, r.stock_code, r.value AS y, CASE WHEN reason IS NULL THEN e END AS residual, reason AS skipped_reason
    FROM returns r JOIN reasons USING (date) LEFT JOIN (SELECT date, stock_code, e FROM left_over) s ON s.date = r.date AND s.stock_code = r.stock_code WHERE r.value IS NOT NULL""",
    "y residual",
    _exact_days(),
    6,
)
def neutralize_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact residuals on all exposures: industries, boards, index flags and size."""
    p, r, _ = _market(spark, sf_dir)
    return neutralize.neutralize(r, p, neutralize.EXACT).select("date", "stock_code", "y", "residual", "skipped_reason")


def _signal_sql(kind: str, y: str) -> str:
    return f"""
{kind}_given AS (SELECT date, stock_code, industry, board, {y} AS y, market_cap, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FLAGS)} FROM panel WHERE market_cap > 0),
{kind}_sized AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY market_cap) + (count(*) OVER (PARTITION BY date, market_cap) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5 AS x FROM {kind}_given),
{kind}_days AS (SELECT date, count(*) AS n, count(DISTINCT industry) + count(DISTINCT board) - 1 + {" + ".join(f"CAST(stddev_pop({c}) > 1e-12 AS INT)" for c in [*FLAGS, "x"])} AS k, stddev_pop(y) AS sd FROM {kind}_sized GROUP BY date),
{_projected(f"{kind}_sized", "y", [*FLAGS, "x"], f"{kind}_left")}"""


@query(
    """SELECT 'value' AS input, l.date, stock_code, CASE WHEN n >= 30 AND n > k + 10 THEN e / sd END AS scaled FROM value_left l JOIN value_days USING (date)
    UNION ALL SELECT 'rank', l.date, stock_code, CASE WHEN n >= 30 AND n > k + 10 THEN e / sd END FROM rank_left l JOIN rank_days USING (date)""",
    "scaled",
    f"""{_signal_sql("value", "alpha")},
{_signal_sql("rank", "(rank() OVER (PARTITION BY date ORDER BY alpha) + (count(*) OVER (PARTITION BY date, alpha) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5")}""",
    6,
)
def neutralized_signal_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal and its rank after neutralisation, in deviations of what went in."""
    p = market.panel(spark, sf_dir)
    both = neutralize.neutralize_signal(p.select("date", "stock_code", F.col("alpha").alias("value")), p)
    told = [t.select(F.lit(kind).alias("input"), "date", "stock_code", (F.col("residual") / F.stddev_pop("y").over(Window.partitionBy("date"))).alias("scaled")) for kind, t in both.items()]
    return told[0].unionByName(told[1])


@query(
    f"""SELECT stock_code, count(*) AS n_obs, stddev_pop(y) AS raw_std, stddev_pop(e) AS residual_std, avg(y) AS raw_mean, avg(e) AS residual_mean, {_corr("y", "e")} AS correlation
    FROM left_over JOIN reasons USING (date) WHERE reason IS NULL GROUP BY stock_code""",
    "raw_std residual_std raw_mean residual_mean correlation",
    _exact_days(),
    6,
)
def symbol_examples_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stock before and after exact neutralisation."""
    p, r, _ = _market(spark, sf_dir)
    return neutralize.symbol_examples(r, neutralize.neutralize(r, p, neutralize.EXACT))


@query()
def neutralize_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    both = neutralize.neutralize_signal(p.select("date", "stock_code", F.col("alpha").alias("value")), p)
    return both["value"].withColumn("input", F.lit("value")).unionByName(both["rank"].withColumn("input", F.lit("rank")))


@query(
    """SELECT score_col, count(r2) AS date_count, avg(r2) AS mean_r2, median(r2) AS median_r2, quantile_cont(r2, 0.9) AS p90_r2, avg(CASE WHEN n > rank THEN 1 - (1 - r2) * (n - 1) / (n - rank) END) AS mean_adj_r2 FROM (
      SELECT score_col, date, n, rank, CASE WHEN t2 > 1e-12 THEN 1 - e2 / t2 END AS r2 FROM (
        SELECT 'alpha' AS score_col, date, count(*) AS n, count(DISTINCT industry) + any_value(free) AS rank, sum(e * e) AS e2, var_pop(alpha) * count(*) AS t2 FROM alpha_left GROUP BY date
        UNION ALL SELECT 'turnover', date, count(*), count(DISTINCT industry) + any_value(free), sum(e * e), var_pop(turnover) * count(*) FROM turnover_left GROUP BY date)) GROUP BY score_col""",
    "mean_r2 median_r2 p90_r2 mean_adj_r2",
    f"{FEATURES.rstrip()},\n{_projected('features', 'alpha', ['log_mcap_z', 'mcap_rank'], 'alpha_left')},\n{_projected('features', 'turnover', ['log_mcap_z', 'mcap_rank'], 'turnover_left')}",
    6,
)
def risk_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _features(market.panel(spark, sf_dir))
    daily, _ = neutralize.risk_r2(p, ["alpha", "turnover"], ["industry", "board"], ["log_mcap_z", "mcap_rank"])
    return neutralize.summarize_r2(daily)


WITHIN_INDUSTRY = f"""
given AS (SELECT date, stock_code, industry, board, value AS y, market_cap FROM returns JOIN panel USING (date, stock_code) WHERE value IS NOT NULL AND market_cap > 0),
sized AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY market_cap) + (count(*) OVER (PARTITION BY date, market_cap) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5 AS x, count(*) OVER (PARTITION BY date) AS n FROM given),
designs AS (SELECT date, any_value(n) AS n, count(DISTINCT industry) + count(DISTINCT board) - 1 + CAST(stddev_pop(x) > 1e-12 AS INT) AS k FROM sized GROUP BY date),
centred AS (SELECT *, y - avg(y) OVER (PARTITION BY date, industry) AS yc, x - avg(x) OVER (PARTITION BY date, industry) AS xc FROM sized),
slopes AS (SELECT date, coalesce(sum(xc * yc) / nullif(sum(xc * xc), 0), 0) AS b FROM centred GROUP BY date),
solved AS (SELECT *, yc - b * xc AS e FROM centred JOIN slopes USING (date) JOIN (SELECT date, k FROM designs WHERE n >= 30 AND n > k + 10) USING (date))"""


@query(
    """SELECT r.date, r.stock_code, r.value AS y, e AS residual, CASE WHEN e IS NOT NULL THEN 'lstsq' END AS method,
      CASE WHEN coalesce(n, 0) < 30 THEN 'too_few_valid_observations' WHEN n <= k + 10 THEN 'too_few_observations_for_design' END AS skipped_reason
    FROM returns r LEFT JOIN designs USING (date) LEFT JOIN (SELECT date, stock_code, e FROM solved) s ON s.date = r.date AND s.stock_code = r.stock_code WHERE r.value IS NOT NULL""",
    "y residual",
    WITHIN_INDUSTRY,
    6,
)
def neutralize_within_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact residuals on industries, boards and size: boards hold whole industries, so SQL has them by means within an industry."""
    p, r, _ = _market(spark, sf_dir)
    return neutralize.neutralize(r, p, replace(neutralize.EXACT, flags=())).select("date", "stock_code", "y", "residual", F.when(F.col("residual").isNotNull(), F.col("method")).alias("method"), "skipped_reason")


@query(
    """SELECT date, count(*) AS n_total, count(value) AS n_valid_return, CASE WHEN coalesce(any_value(n), 0) < 30 THEN 'too_few_valid_observations' WHEN any_value(n) <= any_value(k) + 10 THEN 'too_few_observations_for_design' END AS skipped_reason,
      CASE WHEN any_value(n) >= 30 THEN any_value(k) ELSE 0 END AS n_columns, any_value(m) AS return_weighted_mean, any_value(sd) AS residual_weighted_std, any_value(r2) AS r2, any_value(zero) AS residual_weighted_mean, any_value(zero) AS max_abs_industry_mean_after, any_value(zero) AS max_abs_board_mean_after, any_value(zero) AS max_abs_continuous_exposure_after
    FROM returns LEFT JOIN designs USING (date) LEFT JOIN (SELECT date, avg(y) AS m, stddev_pop(e) AS sd, 1 - avg(e * e) / var_pop(y) AS r2, 0.0 AS zero FROM solved GROUP BY date) USING (date) GROUP BY date""",
    "return_weighted_mean residual_weighted_std r2 residual_weighted_mean max_abs_industry_mean_after max_abs_board_mean_after max_abs_continuous_exposure_after",
    WITHIN_INDUSTRY,
    6,
)
def neutralization_day_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the diagnostics of exact residuals promise by date: counts, reasons to skip, the design, and nothing left in any group."""
    p, r, _ = _market(spark, sf_dir)
    told = neutralize.neutralize_tables(r, p, replace(neutralize.EXACT, flags=()))["diagnostics"]
    left = ["residual_weighted_mean", "max_abs_industry_mean_after", "max_abs_board_mean_after", "max_abs_continuous_exposure_after"]
    return told.select("date", "n_total", "n_valid_return", "skipped_reason", "n_columns", "return_weighted_mean", "residual_weighted_std", "r2", *[F.round(F.abs(c), 9).alias(c) for c in left])


@query(
    """SELECT count(*) AS date_count, count(*) FILTER (done) AS processed_date_count, count(*) FILTER (NOT done) AS skipped_date_count, min(date) AS date_min, max(date) AS date_max, 'exact_neutralization' AS neutralization_type
    FROM (SELECT date, coalesce(any_value(n) >= 30 AND any_value(n) > any_value(k) + 10, false) AS done FROM returns LEFT JOIN designs USING (date) GROUP BY date)""",
    "",
    WITHIN_INDUSTRY,
)
def neutralization_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, _ = _market(spark, sf_dir)
    told = neutralize.neutralization_summary(neutralize.neutralize_tables(r, p, replace(neutralize.EXACT, flags=()))["diagnostics"])
    return told.drop("max_abs_industry_mean_after", "max_abs_board_mean_after", "max_abs_continuous_exposure_after")


def _levels(columns: dict[str, str]) -> str:
    stats = lambda c, x: f"count({x}) AS {c}_count, avg({x}) AS {c}_mean, stddev_pop({x}) AS {c}_std, min({x}) AS {c}_min, max({x}) AS {c}_max, " + ", ".join(f"count(*) FILTER (abs({x}) > {t / 100}) AS {c}_abs_gt_{t}pct" for t in (10, 20, 50))
    return ", ".join(stats(c, x) for c, x in columns.items())


@query(
    f"""SELECT CASE WHEN grouping(r.date) = 0 THEN 'date' WHEN grouping(r.stock_code) = 0 THEN 'stock' ELSE 'all' END AS level, r.date, r.stock_code, {_levels({"raw": "r.value", "residual": "e"})}
    FROM returns r LEFT JOIN (SELECT date, stock_code, e FROM solved) s ON s.date = r.date AND s.stock_code = r.stock_code WHERE r.value IS NOT NULL GROUP BY GROUPING SETS ((r.date), (r.stock_code), ())""",
    "raw_mean raw_std raw_min raw_max residual_mean residual_std residual_min residual_max",
    WITHIN_INDUSTRY,
    6,
)
def neutralization_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before and after neutralisation by date, by stock and in all."""
    p, r, _ = _market(spark, sf_dir)
    residual = neutralize.neutralize(r, p, replace(neutralize.EXACT, flags=()))
    return quality.level_stats(residual.select("date", "stock_code", F.col("y").alias("raw"), "residual"), ["raw", "residual"])


@query(
    f"""SELECT 'alpha' AS score_col, count(r2) AS date_count, avg(r2) AS mean_r2, median(r2) AS median_r2, quantile_cont(r2, 0.9) AS p90_r2, avg(1 - (1 - r2) * (n - 1) / (n - k)) AS mean_adj_r2 FROM (
      SELECT date, n, k, 1 - e2 / t2 AS r2 FROM (SELECT date, any_value(n) AS n, any_value(k) AS k, sum((yc - b * xc) ** 2) AS e2, any_value(vt) * any_value(n) AS t2 FROM alpha_centred JOIN alpha_slopes USING (date) GROUP BY date) WHERE t2 > 1e-12 AND n > k)""",
    "mean_r2 median_r2 p90_r2 mean_adj_r2",
    """
alpha_ranked AS (SELECT date, industry, alpha AS y, (rank() OVER (PARTITION BY date ORDER BY market_cap) + (count(*) OVER (PARTITION BY date, market_cap) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5 AS x FROM panel),
alpha_centred AS (SELECT date, y - avg(y) OVER i AS yc, x - avg(x) OVER i AS xc, count(*) OVER d AS n, var_pop(y) OVER d AS vt, (SELECT count(DISTINCT industry) FROM alpha_ranked a WHERE a.date = r.date) + 1 AS k FROM alpha_ranked r WINDOW i AS (PARTITION BY date, industry), d AS (PARTITION BY date)),
alpha_slopes AS (SELECT date, coalesce(sum(xc * yc) / nullif(sum(xc * xc), 0), 0) AS b FROM alpha_centred GROUP BY date)""",
    6,
)
def risk_r2_of_industry_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _features(market.panel(spark, sf_dir))
    daily, _ = neutralize.risk_r2(p, ["alpha"], ["industry"], ["mcap_rank"])
    enough = daily.where("n_obs > 0 and adj_r2 is not null and not isnan(adj_r2)")
    return neutralize.summarize_r2(enough)


@query(
    f"""SELECT date, count(*) AS n_obs, {_corr("alpha", "value")} AS ic, {_corr("rs", "rt")} AS rank_ic,
      CASE WHEN count(*) >= 10 AND min(alpha) < max(alpha) THEN avg(value) FILTER (q = 10) - avg(value) FILTER (q = 1) END AS decile_spread FROM (
      SELECT *, greatest(ceil((rn - 1) * least(10, n) / nullif(n - 1, 0)), 1) AS q FROM (
        SELECT date, alpha, value, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY alpha, stock_code) AS rn,
          rank() OVER (PARTITION BY date ORDER BY alpha) + (count(*) OVER (PARTITION BY date, alpha) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0 AS rt
        FROM panel JOIN returns USING (date, stock_code) WHERE value IS NOT NULL)) GROUP BY ALL""",
    "ic rank_ic decile_spread",
)
def decile_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r, _ = _market(spark, sf_dir)
    return neutralize.decile_performance(p.join(r, ["date", "stock_code"]), "alpha", "value")


#: Trees of the registered trainings; all other parameters are the defaults.
TREES = {"n_estimators": 20}


@query()
def train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds with the default model, whose neutralised signals are held monotone."""
    from ..operators import model

    # written once: signal, exposures, context and labels come from the panel, and dates and folds from what is built
    p, own = stored(market.panel(spark, sf_dir), "market")
    r = market.returns(p)
    residual = neutralize.neutralize_signal(p.select("date", "stock_code", F.col("alpha").alias("value")), p)["value"]
    signal = {"alpha_neutralized": residual.select("date", "stock_code", F.col("residual").alias("value"))}
    built = panel.build_panel(p, r, signal, {"alpha_neutralized": "identity"}, liquidity=["turnover"])
    roles = panel.feature_roles([*signal], ["turnover"])
    c = model.contract(roles, "y_raw_fwd", model.neutralized_signals(model.contract(roles, "y_raw_fwd")))
    built, own_built = stored(built.select("date", "stock_code", "y_raw_fwd", "sample_weight", *c.features), "built")
    forget(spark, own)
    folds = panel.fold_assignments(built.select("date"), market.FOLDS, 1)
    out = model.train_folds(built, folds, c, "y_raw_fwd", params=TREES)["predictions"]
    forget(spark, own_built)
    return out


SPLITS = """
rows_ AS (
  SELECT turnover, volume, dense_rank() OVER (ORDER BY industry) - 1 AS industry, value AS y, 1.0 + CAST(stock_code AS INT) % 3 AS w FROM panel JOIN returns USING (date, stock_code) WHERE value IS NOT NULL),
graded AS (SELECT *, greatest(least((SELECT sum(w * y) / sum(w) FROM rows_) - y, 0.1), -0.1) * w AS g FROM rows_),
long_ AS (SELECT feature, x, g, w FROM graded UNPIVOT (x FOR feature IN (turnover, volume))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM long_),
edges AS (SELECT DISTINCT feature, x AS edge FROM ordered WHERE rn IN (SELECT greatest(CAST(ceil(k / 255.0::DOUBLE * n) AS BIGINT), 1) FROM range(1, 255) t(k))),
binned AS (SELECT o.feature, coalesce(e.edge, 1e300) AS bin, g, w FROM ordered o ASOF LEFT JOIN edges e ON o.feature = e.feature AND o.x <= e.edge),
sums AS (
  SELECT feature, bin, 2.0 AS l2, sum(g) AS g, sum(w) AS h, count(*) AS n FROM binned GROUP BY ALL
  UNION ALL SELECT 'industry', sum(g) / (sum(w) + 15), 5.0, sum(g), sum(w), count(*) FROM graded GROUP BY industry HAVING count(*) >= 15),
lefts AS (
  SELECT feature, l2, row_number() OVER o AS position, sum(n) OVER o AS n, sum(g) OVER o AS g, sum(h) OVER o AS h FROM sums WINDOW o AS (PARTITION BY feature ORDER BY bin)),
total AS (SELECT sum(g) AS g, sum(w) AS h, count(*) AS n FROM graded)"""


@query(
    """SELECT feature, position, CAST(l.n AS BIGINT) AS left_rows, l.g ** 2 / (l.h + l2) + (t.g - l.g) ** 2 / (t.h - l.h + l2) - t.g ** 2 / (t.h + 2.0) AS gain
    FROM lefts l, total t WHERE l.n >= 500 AND t.n - l.n >= 500""",
    "gain",
    SPLITS,
    6,
)
def first_split_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of every candidate split of a first tree: Huber slopes over all labelled rows, numbers by bins, industries as sets."""
    from ..operators import boosting

    p, r, _ = _market(spark, sf_dir)
    levels = [x[0] for x in p.select("industry").distinct().orderBy("industry").collect()]  # a row for each industry
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(levels) for x in (v, float(k))]), F.col("industry"))
    rows = p.withColumn("industry", code).join(r.where("value is not null"), ["date", "stock_code"])
    weight = 1.0 + F.col("stock_code").cast("int") % 3
    return boosting.root_gains(rows, ["turnover", "volume", "industry"], F.col("value"), weight, {"industry": len(levels)}, alpha=0.1)


# ---- diagnosis

@query("SELECT split, score_col, sum(mean_ic * date_count) / sum(date_count) FILTER (mean_ic IS NOT NULL) AS weighted_mean_ic, CAST(sum(date_count) FILTER (mean_ic IS NOT NULL) AS BIGINT) AS total_weight FROM (SELECT fold_id, split, score_col, count(*) AS date_count, avg(ic) AS mean_ic FROM ic GROUP BY ALL) GROUP BY ALL", "weighted_mean_ic", IC)
def weighted_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.weighted_mean(evaluate.summarize_ic(evaluate.daily_ic(_frame(spark, sf_dir), SCORES, "value")), "mean_ic")


@query("SELECT *, avg(ic) OVER (PARTITION BY fold_id, split, score_col ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ic_rolling FROM ic", "ic rank_ic ic_rolling", IC)
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.rolling_mean(evaluate.daily_ic(_frame(spark, sf_dir), SCORES, "value"), "ic", ["fold_id", "split", "score_col"])


@query(
    """SELECT fold_id, split, bucket_index, bucket_label, sum(abs(m)) / 2 AS active_share, max(abs(m)) AS largest_active, arg_min(industry, (-round(abs(m), 10), industry)) AS largest_segment
    FROM (SELECT fold_id, split, bucket_index, bucket_label, industry, avg(active_weight) AS m FROM composition GROUP BY ALL) GROUP BY ALL""",
    "active_share largest_active",
    f"{RANKED.rstrip()},{CATEGORY}",
    6,
)
def top_bucket_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed, ranked = _composition(spark, sf_dir)
    return diagnose.bucket_style(nav.summarize_composition(nav.category_composition(bucketed, ranked, "industry"), "industry"), "industry")


STITCHED = f"""{RANKED.rstrip()},
filled AS (SELECT * REPLACE (coalesce(bucket_return, 0.0) AS bucket_return) FROM daily WHERE split = 'test'),
stitched AS (
  SELECT *, gross_nav / greatest(1.0, max(gross_nav) OVER (PARTITION BY bucket_index ORDER BY date)) - 1 AS drawdown FROM (
    SELECT *, exp(sum(ln(1 + bucket_return)) OVER (PARTITION BY bucket_index ORDER BY date)) AS gross_nav FROM filled)),{_underwater("bucket_index, bucket_label", "stitched").replace("gross_nav >= greatest", "gross_nav + 1e-12 >= greatest")}"""


@query(f"SELECT * FROM (SELECT bucket_index, bucket_label, {SUMMARY} FROM stitched GROUP BY ALL) JOIN under USING (bucket_index, bucket_label)", SUMMARY_DOUBLES, STITCHED, 6)
def stitched_bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, pred = _market(spark, sf_dir)
    return diagnose.stitched_summary(nav.bucket_returns(nav.rank_scores(pred, "pred_a"), r, BUCKETS))
