"""Queries on panels and tables: folds, weights, features, one-hots, returns, membership, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.stats import QUANTILES
from ..functions.storage import forget, stored
from ..operators import diagnose, membership, neutralize, panel, quality, returns
from . import market
from .registry import query

FLAGS = "is_csi300 is_csi500 is_csi1000 is_csi2000".split()


# ---- folds and weights

@query("SELECT fold_id, split, date FROM folds WHERE (fold_id, split, date) NOT IN (SELECT fold_id, split, date FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, split ORDER BY date DESC) AS k FROM folds WHERE split <> 'test') WHERE k <= 2)")
def fold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.fold_assignments(market.panel(spark, sf_dir).select("date"), market.FOLDS, 2)


@query("SELECT fold_id, split, date FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, split ORDER BY date DESC) AS k FROM folds WHERE split <> 'test') WHERE k <= 2")
def embargo_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.embargo_dates(market.panel(spark, sf_dir).select("date"), market.FOLDS, 2)


WEIGHTS = "weighted AS (SELECT *, (SELECT count(*) FROM panel) / ((SELECT count(DISTINCT date) FROM panel) * count(*) OVER (PARTITION BY date)) AS sample_weight FROM panel)"


@query("SELECT date, stock_code, sample_weight FROM weighted", "sample_weight", WEIGHTS)
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.sample_weights(market.panel(spark, sf_dir)).select("date", "stock_code", "sample_weight")


@query(
    """SELECT fold_id, split, min(date) AS start_date, max(date) AS end_date, count(*) AS date_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, max(s) AS max_stocks, sum(w) AS weight_sum
    FROM folds LEFT JOIN (SELECT date, count(*) AS n, count(DISTINCT stock_code) AS s, sum(sample_weight) AS w FROM weighted GROUP BY date) USING (date) GROUP BY ALL""",
    "weight_sum",
    WEIGHTS,
    6,
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.sample_weights(market.panel(spark, sf_dir))
    return panel.split_summary(p, panel.fold_assignments(p.select("date"), market.FOLDS))


# ---- features

def _rank(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5"


def _z(source: str, x: str, tag: str) -> str:
    """Chained expressions from ``source``: z of the column ``x``."""
    return f"""
{tag}_1 AS (SELECT *, CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, 0.01) OVER (PARTITION BY date)), quantile_cont({x}, 0.99) OVER (PARTITION BY date)) END AS {tag}_x FROM {source}),
{tag}_2 AS (SELECT *, median({tag}_x) OVER (PARTITION BY date) AS {tag}_m, stddev_pop({tag}_x) OVER (PARTITION BY date) AS {tag}_s FROM {tag}_1),
{tag}_3 AS (SELECT *, 1.4826 * median(abs({tag}_x - {tag}_m)) OVER (PARTITION BY date) AS {tag}_d FROM {tag}_2),
{tag} AS (SELECT *, CASE WHEN {tag}_x IS NOT NULL THEN least(greatest(({tag}_x - {tag}_m) / CASE WHEN {tag}_d > 1e-12 THEN {tag}_d WHEN {tag}_s > 1e-12 THEN {tag}_s ELSE 1.0 END, -5.0), 5.0) END AS {tag}_z FROM {tag}_3)"""


ALPHA = f"based AS (SELECT *, ln(market_cap) AS lc, CASE WHEN alpha > 0 THEN ln(alpha) END AS la, ln(1 + turnover) AS lt FROM panel),{_z('based', 'la', 'alpha_signal')},{_z('alpha_signal', 'lc', 'log_mcap')},{_z('log_mcap', 'lt', 'turnover')}"


def _alpha_panel(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    p = market.panel(spark, sf_dir) if p is None else p
    signal = p.select("date", "stock_code", F.col("alpha").alias("value"))
    return panel.build_panel(p, market.returns(p), {"alpha_signal": signal}, {"alpha_signal": "log_positive"}, liquidity=["turnover"])


@query(
    f"""SELECT date, stock_code, alpha_signal_rank, alpha_signal_z, turnover_rank, turnover_z, log_mcap_z, mcap_rank, size_decile, index_bucket, y_raw_fwd, y_raw_rank_label,
      u / (d * n_date) AS sample_weight FROM (
      SELECT *, sum(n_date / n_panel) OVER () AS u, (SELECT count(DISTINCT date) FROM labelled) AS d FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n_panel FROM labelled))""",
    "alpha_signal_rank alpha_signal_z turnover_rank turnover_z log_mcap_z mcap_rank y_raw_fwd y_raw_rank_label sample_weight",
    f"""{ALPHA},
    ranked AS (SELECT *, (rank() OVER (PARTITION BY date, alpha > 0 ORDER BY alpha) + (count(*) OVER (PARTITION BY date, alpha) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date, alpha > 0) - 0.5 AS alpha_signal_rank,
      {_rank("turnover")} AS turnover_rank, {_rank("market_cap")} AS mcap_rank, count(*) FILTER (alpha > 0) OVER (PARTITION BY date) AS n_date,
      CAST(ceil(10.0 * row_number() OVER (PARTITION BY date ORDER BY market_cap, stock_code) / count(*) OVER (PARTITION BY date)) - 1 AS BIGINT) AS size_decile,
      CASE WHEN is_csi300 = 1 THEN 'CSI300' WHEN is_csi500 = 1 THEN 'CSI500' WHEN is_csi1000 = 1 THEN 'CSI1000' WHEN is_csi2000 = 1 THEN 'CSI2000' ELSE 'NON_INDEX' END AS index_bucket FROM turnover),
    universe AS (SELECT * FROM ranked WHERE alpha > 0),
    known AS (SELECT *, {_rank("value")} AS y_raw_rank_label FROM returns WHERE value IS NOT NULL),
    labelled AS (SELECT u.*, value AS y_raw_fwd, y_raw_rank_label FROM universe u JOIN known USING (date, stock_code))""",
    6,
)
def alpha_feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alpha_panel(spark, sf_dir).select("date", "stock_code", "alpha_signal_rank", "alpha_signal_z", "turnover_rank", "turnover_z", "log_mcap_z", "mcap_rank", "size_decile", "index_bucket", "y_raw_fwd", "y_raw_rank_label", "sample_weight")


@query(
    """SELECT CASE WHEN fold_id IS NULL THEN 'all' WHEN grouping(split) = 1 THEN 'fold' ELSE 'split' END AS level, coalesce(fold_id, 0) AS fold_id, coalesce(split, '') AS split, count(*) AS row_count, count(DISTINCT date) AS date_count, count(DISTINCT stock_code) AS stock_count,
      min(date) AS start_date, max(date) AS end_date, sum(weight) AS weight_sum, count(*) FILTER (z IS NULL) AS missing_alpha_signal_z
    FROM (SELECT fold_id, split, date, stock_code, weight, z FROM weighted JOIN folds USING (date)) GROUP BY GROUPING SETS ((fold_id, split), (fold_id))
    UNION ALL SELECT 'all', 0, '', count(*), count(DISTINCT date), count(DISTINCT stock_code), min(date), max(date), sum(weight), count(*) FILTER (z IS NULL) FROM weighted""",
    "weight_sum",
    f"""{ALPHA},
    universe AS (SELECT *, count(*) OVER (PARTITION BY date) AS n_date FROM turnover WHERE alpha > 0),
    labelled AS (SELECT u.date, u.stock_code, u.alpha_signal_z AS z, n_date FROM universe u JOIN returns r USING (date, stock_code) WHERE r.value IS NOT NULL),
    weighted AS (SELECT date, stock_code, z, (SELECT sum(n) FROM (SELECT any_value(n_date) AS n FROM labelled GROUP BY date)) / ((SELECT count(DISTINCT date) FROM labelled) * n_date) AS weight FROM labelled)""",
    6,
)
def training_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a training panel holds by split, by fold and in all."""
    built = _alpha_panel(spark, sf_dir)
    told = panel.run_summary(built, panel.fold_assignments(built.select("date"), market.FOLDS), ["alpha_signal_z"])
    return told.withColumns({"fold_id": F.coalesce("fold_id", F.lit(0)), "split": F.coalesce("split", F.lit(""))})


@query(
    """SELECT fold_id, split, count(*) AS row_count, count(DISTINCT date) AS date_count, min(date) AS start_date, max(date) AS end_date, 0 AS without_prediction, 0 AS wrong_margins, true AS stopped_at_best
    FROM labelled JOIN folds USING (date) GROUP BY ALL""",
    "",
    f"""{ALPHA},
    known AS (SELECT * FROM returns WHERE value IS NOT NULL),
    labelled AS (SELECT date, stock_code FROM turnover JOIN known USING (date, stock_code) WHERE alpha > 0)""",
)
def training_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of a training of all folds: rows and dates of each split, a prediction for every row, margins that are differences, and a
    valid loss of the predictions that is the one at which training stopped."""
    from ..operators import model
    from ..operators.boosting import Settings

    # written once: context, signal and labels come from the panel, and dates and folds from what is built
    p, own = stored(market.panel(spark, sf_dir), "market")
    built = _alpha_panel(spark, sf_dir, p)
    roles = panel.feature_roles(["alpha_signal"], ["turnover"])
    plain = model.contract(roles, "y_raw_fwd")
    c = model.contract(roles, "y_raw_fwd", model.monotone_signals(plain, all_signals=True))
    built, own_built = stored(built.select("date", "stock_code", "y_raw_fwd", "sample_weight", *c.features), "built")
    forget(spark, own)
    out = model.train_folds(built, panel.fold_assignments(built.select("date"), market.FOLDS), c, "y_raw_fwd", params={"n_estimators": 8}, predicted=("train", "valid", "test"))
    forget(spark, own_built)
    alpha, size = Settings().alpha, F.abs(F.col("pred_direct") - F.col("y_true"))
    loss = F.when(size <= alpha, size * size / 2).otherwise(alpha * (size - alpha / 2))
    known = spark.createDataFrame([(f, m.losses[m.best_iteration]) for f, m in out["models"].items()], "fold_id long, best_loss double")
    off = F.abs(F.col("score_marginal") - (F.col("pred_direct") - F.col("pred_context_only"))) > 1e-12
    told = out["predictions"].groupBy("fold_id", "split").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred_direct").isNull()).alias("without_prediction"), F.count_if(off).alias("wrong_margins"), (F.sum(loss * F.col("sample_weight")) / F.sum("sample_weight")).alias("loss")
    )
    both = out["folds"].join(told, ["fold_id", "split"]).join(known, "fold_id").where("n = row_count")
    at_best = (F.col("split") != "valid") | (F.abs(F.col("loss") - F.col("best_loss")) < 1e-7)
    return both.select("fold_id", "split", "row_count", "date_count", "start_date", "end_date", "without_prediction", "wrong_margins", at_best.alias("stopped_at_best"))



@query(
    f"""SELECT * EXCLUDE (n_date, n_panel, n_dates), n_panel / (n_dates * n_date) AS sample_weight FROM (
      SELECT *, {_rank("y_raw_fwd")} AS y_raw_rank_label, count(*) OVER (PARTITION BY date) AS n_date, count(*) OVER () AS n_panel, (SELECT count(DISTINCT date) FROM held) AS n_dates FROM held)""",
    "market_cap volume amount_k turnover alpha placeholder_raw log_mcap mcap_rank log_mcap_z placeholder_rank placeholder_z y_raw_fwd y_raw_rank_label sample_weight",
    f"""labelled AS (SELECT p.*, value, ln(market_cap) AS lc FROM panel p JOIN returns USING (date, stock_code)),{_z('labelled', 'alpha', 'placeholder')},{_z('placeholder', 'lc', 'log_mcap')},
    sized AS (SELECT *, {_rank("alpha")} AS placeholder_rank, {_rank("market_cap")} AS mcap_rank,
      CAST(ceil(10.0 * row_number() OVER (PARTITION BY date ORDER BY market_cap, stock_code) / count(*) OVER (PARTITION BY date)) - 1 AS BIGINT) AS size_decile,
      CASE WHEN is_csi300 = 1 THEN 'CSI300' WHEN is_csi500 = 1 THEN 'CSI500' WHEN is_csi1000 = 1 THEN 'CSI1000' WHEN is_csi2000 = 1 THEN 'CSI2000' ELSE 'NON_INDEX' END AS index_bucket FROM log_mcap),
    held AS (
      SELECT date, stock_code, industry, board, CAST(is_csi300 AS DOUBLE) AS is_csi300, CAST(is_csi500 AS DOUBLE) AS is_csi500, CAST(is_csi1000 AS DOUBLE) AS is_csi1000, CAST(is_csi2000 AS DOUBLE) AS is_csi2000,
        market_cap, volume, amount_k, turnover, alpha, alpha AS placeholder_raw, lc AS log_mcap, mcap_rank, size_decile, log_mcap_z, index_bucket, placeholder_rank, placeholder_z, value AS y_raw_fwd FROM sized WHERE value IS NOT NULL)""",
    6,
)
def placeholder_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sections taken after the labels are joined."""
    p = market.panel(spark, sf_dir)
    signal = p.select("date", "stock_code", F.col("alpha").alias("value"))
    return panel.build_panel(p, market.returns(p), {"placeholder": signal}, {"placeholder": "identity"}, universe_first=False)


@query(
    """SELECT signal, count(*) AS rows, count(*) - count(v) AS missing, count(DISTINCT date) FILTER (v IS NOT NULL) AS dates
    FROM (SELECT date, unnest(['a_raw', 'v_raw']) AS signal, unnest([alpha, CASE WHEN volume > 100 THEN volume END]) AS v FROM panel) GROUP BY signal"""
)
def alpha_signal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    frame = panel.attach_signals(p, {"a": p.select("date", "stock_code", F.col("alpha").alias("value")), "v": p.where("volume > 100").select("date", "stock_code", F.col("volume").alias("value"))})
    return panel.signal_diagnostics(frame, ["a", "v"])


@query(
    f"SELECT date, count(*) AS row_count, avg(y) AS y_mean, avg(k) AS k_mean, stddev_pop(y) AS y_std, stddev_pop(k) AS k_std, min(y) AS y_min, min(k) AS k_min, max(y) AS y_max, max(k) AS k_max FROM (SELECT date, value AS y, {_rank('value')} AS k FROM returns WHERE value IS NOT NULL) GROUP BY date",
    "y_mean k_mean y_std k_std y_min k_min y_max k_max",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.label_distribution(panel.labels(market.returns(market.panel(spark, sf_dir)), "y", "k"), ["y", "k"])


@query(
    "SELECT date, feature, count(v) AS count, count(*) - count(v) AS missing, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS std, min(v) AS min, max(v) AS max FROM (SELECT date, unnest(['turnover', 'value']) AS feature, unnest([turnover, value]) AS v FROM panel LEFT JOIN returns USING (date, stock_code)) GROUP BY ALL",
    "mean median std min max",
)
def feature_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return panel.feature_diagnostics(p.join(market.returns(p), ["date", "stock_code"], "left"), ["turnover", "value"])


@query("SELECT date, stock_code, CASE WHEN is_csi300 = 1 THEN 'CSI300' WHEN is_csi500 = 1 THEN 'CSI500' WHEN is_csi1000 = 1 THEN 'CSI1000' WHEN is_csi2000 = 1 THEN 'CSI2000' ELSE 'NON_INDEX' END AS bucket FROM panel")
def index_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.panel(spark, sf_dir).select("date", "stock_code", keys.index_bucket("UNKNOWN_INDEX").alias("bucket"))


BOARDS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("SELECT date, stock_code, " + ", ".join(f"CAST(board = '{b}' AS BIGINT) AS \"board__{b}\"" for b in BOARDS) + " FROM panel")
def board_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row whose board is none of these, or that does not sum to 1, stops the query."""
    return panel.one_hot(market.panel(spark, sf_dir), "board", "board", keys.UNKNOWN_BOARD, BOARDS)


@query("SELECT date, stock_code, CAST(is_csi300 AS BIGINT) AS index__CSI300, CAST(is_csi500 AS BIGINT) AS index__CSI500, CAST(is_csi1000 AS BIGINT) AS index__CSI1000, CAST(is_csi2000 AS BIGINT) AS index__CSI2000, CAST(is_csi300 + is_csi500 + is_csi1000 + is_csi2000 = 0 AS BIGINT) AS index__NON_INDEX, CAST(0 AS BIGINT) AS index__UNKNOWN_INDEX FROM panel")
def index_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.index_one_hot(market.panel(spark, sf_dir))


@query("SELECT date, stock_code, CASE flag WHEN 'is_csi300' THEN 'CSI300' WHEN 'is_csi500' THEN 'CSI500' WHEN 'is_csi1000' THEN 'CSI1000' ELSE 'CSI2000' END AS index_name FROM (UNPIVOT (SELECT date, stock_code, is_csi300, is_csi500, is_csi1000, is_csi2000 FROM panel) ON is_csi300, is_csi500, is_csi1000, is_csi2000 INTO NAME flag VALUE v) WHERE v = 1")
def index_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.index_constituents(market.panel(spark, sf_dir))


@query("SELECT date, stock_code, value FROM (UNPIVOT (SELECT date, sum(CASE WHEN board = 'AMERICA' THEN volume END) AS \"000001\", sum(CASE WHEN board = 'ASIA' THEN volume END) AS \"000002\", sum(CASE WHEN board = 'EUROPE' THEN volume END) AS \"000003\" FROM panel GROUP BY date) ON \"000001\", \"000002\", \"000003\" INTO NAME stock_code VALUE value)", "value")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"000001": "AMERICA", "000002": "ASIA", "000003": "EUROPE"}
    wide = market.panel(spark, sf_dir).groupBy("date").agg(*[F.sum(F.when(F.col("board") == b, F.col("volume"))).alias(c) for c, b in named.items()])
    return panel.wide_to_long(wide)


# ---- keys

@query(
    "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS market_code, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS float_code, '6' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '.SH' AS symbol FROM supplier"
)
def normalize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return market.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        keys.stock_code(F.concat(F.lit(" "), key, F.lit(".SZ"))).alias("market_code"),
        keys.stock_code(F.concat(key, F.lit(".0")), "decimal").alias("float_code"),
        keys.symbol_of(F.concat(F.lit("6"), F.lpad(key, 5, "0"))).alias("symbol"),
    )


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'CHINEXT' WHEN 1 THEN 'STAR' WHEN 2 THEN 'SSE_MAIN' ELSE CASE WHEN prefix IN ('688', '689') THEN 'STAR' WHEN prefix IN ('300', '301', '302') THEN 'CHINEXT' WHEN prefix IN ('600', '601', '603', '605') THEN 'SSE_MAIN' WHEN prefix IN ('000', '001', '002', '003') THEN 'SZSE_MAIN' WHEN prefix = '920' THEN 'BSE' ELSE 'UNKNOWN_BOARD' END END AS board,
      CASE s_suppkey % 4 WHEN 0 THEN 'exchange_market_mapping' WHEN 1 THEN 'market_type_alias' WHEN 2 THEN 'exchange_market_mapping' ELSE CASE WHEN prefix IN ('111', '999') THEN 'unknown' ELSE 'prefix_fallback' END END AS source
    FROM (SELECT s_suppkey, (['688', '300', '600', '000', '920', '111', '999'])[CAST(s_suppkey % 7 AS INT) + 1] AS prefix FROM supplier)"""
)
def board_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    prefix = F.get(F.array(*[F.lit(p) for p in ("688", "300", "600", "000", "920", "111", "999")]), (k % 7).cast("int"))
    market_type = F.when(k % 4 == 0, "创业板").when(k % 4 == 1, "star-board").when(k % 4 == 2, "主板")
    exchange = F.when(k % 4 == 0, "SZ").when(k % 4 == 2, "SHSE").otherwise("")
    df = market.table(spark, sf_dir, "supplier").select("s_suppkey", keys.inferred_board(F.concat(prefix, F.lit("001")), market_type, exchange).alias("b"))
    return df.select("s_suppkey", "b.*")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01')")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order since 1998 (all have older ones)."""
    orders = market.table(spark, sf_dir, "orders").where(F.to_date("o_orderdate") >= dt.date(1998, 1, 1)).select(F.col("o_custkey").alias("c_custkey"))
    return market.table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


# ---- returns

DAILY = """
calendar AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
trades AS (SELECT date, lead(date, 1) OVER (ORDER BY date) AS buy_date, lead(date, 2) OVER (ORDER BY date) AS sell_date FROM calendar),
daily AS (SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount_k,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS turnover, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS close FROM lineitem GROUP BY 1, 2)
"""


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("decimal(18,2)")
    code = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    return market.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), code.alias("stock_code")).agg(
        F.sum(d("l_quantity")).cast("double").alias("volume"), F.sum(d("l_extendedprice")).cast("double").alias("amount_k"), F.sum(d("l_discount")).cast("double").alias("turnover"), F.max(d("l_extendedprice")).cast("double").alias("close")
    )


@query("SELECT * FROM trades", "", DAILY)
def trade_date_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.trade_dates(_calendar(spark, sf_dir))


ADJUST = f"""{DAILY.rstrip()},
factors AS (SELECT date, stock_code, CASE WHEN CAST(stock_code AS INT) % 13 = 0 AND day(date) = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) + (CAST(stock_code AS INT) + day(date)) % 3 * CAST(0.15 AS DOUBLE) END AS factor FROM daily),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY date) AS pos FROM factors),
raw AS (SELECT d.date, d.stock_code, d.turnover - 0.05 AS value FROM daily d),
matched AS (
  SELECT r.date AS signal_date, r.stock_code, t.buy_date, t.sell_date, r.value AS return_raw, b.factor AS factor_buy, s.factor AS factor_sell, b.pos AS buy_pos, s.pos AS sell_pos,
    CASE WHEN b.factor > 0 AND s.factor > 0 THEN s.factor / b.factor END AS factor_ratio
  FROM raw r LEFT JOIN trades t USING (date) LEFT JOIN numbered b ON b.stock_code = r.stock_code AND b.date = t.buy_date LEFT JOIN numbered s ON s.stock_code = r.stock_code AND s.date = t.sell_date),
jumps AS (SELECT stock_code, signal_date, factor_buy, factor_sell, unnest(range(1, 11)) AS k, buy_pos, sell_pos FROM matched WHERE abs(factor_ratio - 1) > 0.2),
reversals AS (
  SELECT DISTINCT stock_code, signal_date, true AS reverses FROM (
    SELECT j.stock_code, signal_date FROM jumps j JOIN numbered n ON n.stock_code = j.stock_code AND n.pos = buy_pos - k WHERE n.factor <> 0 AND abs(n.factor / factor_sell - 1) <= 0.02
    UNION ALL SELECT j.stock_code, signal_date FROM jumps j JOIN numbered n ON n.stock_code = j.stock_code AND n.pos = sell_pos + k WHERE n.factor <> 0 AND abs(n.factor / factor_buy - 1) <= 0.02)),
judged AS (SELECT *, (1 + return_raw) * factor_ratio - 1 AS candidate, coalesce(abs(factor_ratio - 1) > 0.02, false) AS jump_flag, coalesce(abs(factor_ratio - 1) > 0.2, false) AS large_jump_flag,
    coalesce(reverses, false) AS suspicious_flag FROM matched LEFT JOIN reversals USING (stock_code, signal_date)),
adjusted AS (
  SELECT signal_date, stock_code, buy_date, sell_date, return_raw, factor_buy, factor_sell, factor_ratio, candidate, jump_flag, large_jump_flag, suspicious_flag,
    CASE WHEN factor_ratio IS NULL THEN NULL WHEN abs(factor_ratio - 1) <= 1e-12 OR suspicious_flag THEN return_raw ELSE candidate END AS return_adjusted,
    CASE WHEN buy_date IS NULL OR sell_date IS NULL THEN 'nan_missing_trade_date' WHEN factor_buy IS NULL OR factor_sell IS NULL THEN 'nan_missing_factor' WHEN factor_ratio IS NULL THEN 'nan_invalid_factor' WHEN abs(factor_ratio - 1) <= 1e-12 THEN 'unchanged_no_factor_change' WHEN suspicious_flag THEN 'kept_raw_suspicious_factor_reversal' ELSE 'adjusted_by_factor_ratio' END AS action FROM judged)
"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, code = _daily(spark, sf_dir), F.col("stock_code").cast("int")
    hole = (code % 13 == 0) & (F.day("date") == 7)
    factors = daily.select("date", "stock_code", F.when(hole, 0.0).otherwise(1.0 + (code + F.day("date")) % 3 * 0.15).alias("factor"))
    raw = daily.select("date", "stock_code", (F.col("turnover") - 0.05).alias("value"))
    return returns.adjust_returns(raw, factors, _calendar(spark, sf_dir))


@query("SELECT * FROM adjusted", "return_raw factor_buy factor_sell factor_ratio candidate return_adjusted", ADJUST)
def return_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir).drop("reason")


@query("SELECT action, count(*) AS rows, count(*) FILTER (abs(return_raw) > 0.5) AS over_half_raw, count(*) FILTER (abs(return_adjusted) > 0.5) AS over_half_adjusted FROM adjusted GROUP BY ALL", "", ADJUST)
def adjustment_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.action_counts(_adjusted(spark, sf_dir))


@query(
    """SELECT *, ln(1 + amount20) AS logAmount20, ln(1 + adv20) AS logADV20 FROM (SELECT date, stock_code, volume, amount_k, turnover, close, CASE WHEN count(amount_k) OVER w >= 5 THEN avg(amount_k) OVER w END AS amount20, CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END AS adv20, CASE WHEN count(turnover) OVER w >= 5 THEN avg(turnover) OVER w END AS turnover20
    FROM daily WINDOW w AS (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    "volume amount_k turnover close amount20 adv20 turnover20 logAmount20 logADV20",
    DAILY,
    6,
)
def rolling_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.rolling_liquidity(_daily(spark, sf_dir))


# ---- membership

MEMBERS = """
snapshots AS (SELECT date AS snapshot_date, stock_code FROM panel WHERE month(date) IN (3, 9) AND year(date) >= 1996 AND is_csi300 = 1),
manifest AS (SELECT unnest(['CSI300', 'CSI500']) AS index_name, date, CASE WHEN month(date) = 5 THEN 'partial' ELSE 'complete' END AS quality_status FROM (SELECT DISTINCT date FROM panel) WHERE month(date) <> 7),
members AS (
  SELECT index_name, date, stock_code, 100.0 / count(*) OVER (PARTITION BY index_name, date) * CASE WHEN month(date) = 6 THEN 0.5 ELSE 1.0 END AS weight, 'complete' AS quality_status
  FROM (SELECT 'CSI300' AS index_name, date, stock_code FROM panel WHERE is_csi300 = 1 UNION ALL SELECT 'CSI500', date, stock_code FROM panel WHERE is_csi500 = 1) WHERE month(date) <> 8),
quality AS (
  SELECT s.flag, s.index_name, d.date, s.least, s.most, m.quality_status AS source_status, member_count, duplicate_rows, weight_sum,
    CASE WHEN m.quality_status IS NULL THEN 'missing_asof_row' WHEN member_count IS NULL THEN 'missing_partition' ELSE concat_ws(';', CASE WHEN m.quality_status <> 'complete' THEN 'source_quality_status=' || m.quality_status END, CASE WHEN member_count NOT BETWEEN least AND most THEN 'observed_member_count=' || CAST(member_count AS VARCHAR) END, CASE WHEN abs(weight_sum / 100 - 1) > 0.01 THEN 'weight_sum' END) END AS unreliable_reasons
  FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (VALUES ('is_csi300', 'CSI300', 1::BIGINT, 100000::BIGINT), ('is_csi500', 'CSI500', 15, 100000)) s(flag, index_name, least, most)
  LEFT JOIN manifest m USING (index_name, date)
  LEFT JOIN (SELECT index_name, date, count(DISTINCT stock_code) AS member_count, count(stock_code) - count(DISTINCT stock_code) AS duplicate_rows, sum(weight) AS weight_sum FROM members GROUP BY ALL) USING (index_name, date)),
judged AS (SELECT *, unreliable_reasons = '' AS reliable FROM quality)
"""
INDEXES = (membership.IndexSpec("is_csi300", "CSI300", 1, 100000), membership.IndexSpec("is_csi500", "CSI500", 15, 100000))


def _members(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    month = F.month("date")
    names = F.explode(F.array(F.lit("CSI300"), F.lit("CSI500"))).alias("index_name")
    manifest = p.select("date").distinct().where(month != 7).select(names, "date", F.when(month == 5, "partial").otherwise("complete").alias("quality_status"))
    both = [p.where(F.col(i.column) == 1).select(F.lit(i.name).alias("index_name"), "date", "stock_code") for i in INDEXES]
    held = both[0].unionByName(both[1]).where(month != 8)
    share = 100.0 / F.count("*").over(Window.partitionBy("index_name", "date"))
    return manifest, held.select("*", (share * F.when(month == 6, 0.5).otherwise(1.0)).alias("weight"), F.lit("complete").alias("quality_status"))


@query(
    """SELECT p.date, p.stock_code, CAST(m.stock_code IS NOT NULL AS BIGINT) AS member FROM (SELECT date, stock_code, (SELECT max(snapshot_date) FROM snapshots s WHERE s.snapshot_date <= panel.date) AS snapshot_date FROM panel) p
    LEFT JOIN snapshots m ON m.snapshot_date = p.snapshot_date AND m.stock_code = p.stock_code""",
    "",
    MEMBERS,
)
def asof_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    snapshots = p.where(F.month("date").isin(3, 9) & (F.year("date") >= 1996) & (F.col("is_csi300") == 1)).select(F.col("date").alias("snapshot_date"), "stock_code")
    return membership.asof_membership(p.select("date", "stock_code"), snapshots, "member")


@query("SELECT * FROM judged", "weight_sum", MEMBERS, 6)
def pit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return membership.membership_quality(p.select("date"), *_members(p), indexes=INDEXES)


@query(
    """SELECT date, stock_code, a AND is_csi300 = 1 AS is_csi300, b AND is_csi500 = 1 AS is_csi500, NOT a AS is_csi300_unknown, NOT b AS is_csi500_unknown, NOT (a AND b) AS index_membership_any_unknown, a AND b AS index_membership_all_known, true AS historical_pit_index_membership
    FROM panel JOIN (SELECT date, bool_or(reliable) FILTER (flag = 'is_csi300') AS a, bool_or(reliable) FILTER (flag = 'is_csi500') AS b FROM judged GROUP BY date) USING (date)""",
    "",
    MEMBERS,
)
def pit_membership_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    manifest, held = _members(p)
    return membership.membership_panel(p, membership.membership_quality(p.select("date"), manifest, held, INDEXES), held, INDEXES)


@query("SELECT flag, count(*) FILTER (reliable) AS reliable_dates, count(*) FILTER (NOT reliable) AS unreliable_dates, min(member_count) AS fewest_members, max(member_count) AS most_members FROM judged GROUP BY flag", "", MEMBERS)
def membership_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return membership.membership_summary(membership.membership_quality(p.select("date"), *_members(p), indexes=INDEXES))


@query(
    """SELECT p.date, p.stock_code, volume, turnover, industry, CASE WHEN CAST(p.stock_code AS INT) % 2 = 0 THEN 'SSE_MAIN' ELSE 'STAR' END AS listing_board_segment, CAST(p.stock_code AS INT) % 2 = 0 AS is_main_board, is_csi300 = 1 AS in_index FROM panel p""",
    "volume turnover",
)
def daily_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    stocks = p.select("stock_code", "industry").distinct()
    even = F.col("stock_code").cast("int") % 2 == 0
    board = stocks.select("stock_code", F.when(even, "MAIN").otherwise("STAR").alias("listing_board_code"), F.lit("SSE").alias("exchange_code"))
    flags = p.select("date", "stock_code", (F.col("is_csi300") == 1).alias("in_index"))
    df = membership.daily_dataset(p.select("date", "stock_code", "volume", "turnover"), stocks, board, flags)
    return df.select("date", "stock_code", "volume", "turnover", "industry", "listing_board_segment", "is_main_board", "in_index")


@query("SELECT date, count(*) AS row_count, count(DISTINCT stock_code) AS stock_count, count(*) - count(value) AS missing_value FROM returns GROUP BY date")
def partition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.date_counts(market.returns(market.panel(spark, sf_dir)), ["value"])


@query("SELECT industry, count(*) AS row_count FROM panel WHERE date = (SELECT max(date) FROM panel) GROUP BY industry")
def latest_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.latest_category_counts(market.panel(spark, sf_dir), "industry")


@query("SELECT date, industry, min(stock_code) AS stock_code FROM panel GROUP BY date, industry HAVING count(*) = 1")
def singleton_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.singleton_categories(market.panel(spark, sf_dir), "industry")


# ---- quality

def _named(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def _dist(x: str, qs: tuple[float, ...]) -> str:
    return f"count({x}) AS count, avg({x}) AS mean, stddev_pop({x}) AS std, min({x}) AS min, max({x}) AS max, " + ", ".join(f"quantile_cont({x}, {q}) AS {_named(q)}" for q in qs)


def _dist_names(qs: tuple[float, ...]) -> str:
    return " ".join(["mean", "std", "min", "max", *map(_named, qs)])


@query(
    f"""SELECT count(DISTINCT date) AS dates, count(DISTINCT stock_code) AS stocks, count(*) AS cells, count(*) - count(value) AS missing, {_dist("value", quality.PROFILE_QUANTILES)},
      count(*) FILTER (abs(value) > 0.2) AS over_20pct, count(*) FILTER (abs(value) > 0.5) AS over_50pct, count(*) FILTER (abs(value) > 1.0) AS over_100pct, count(*) FILTER (value > 0.1) AS above_10pct, count(*) FILTER (value < -0.1) AS below_minus_10pct,
      count(*) FILTER (value = 0) AS zero, count(*) FILTER (value > 0) AS positive, count(*) FILTER (value < 0) AS negative FROM returns""",
    _dist_names(quality.PROFILE_QUANTILES),
)
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(market.returns(market.panel(spark, sf_dir)))


@query("SELECT stock_code, count(*) AS cells, count(value) AS valid, count(value) / count(*) AS coverage, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS std FROM returns GROUP BY stock_code", "coverage mean std")
def coverage_by_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(market.returns(market.panel(spark, sf_dir)), "stock_code")


@query("SELECT date, count(*) AS cells, count(value) AS valid, count(value) / count(*) AS coverage, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS std FROM returns GROUP BY date ORDER BY valid, date LIMIT 20", "coverage mean std")
def lowest_coverage_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.lowest_coverage(market.returns(market.panel(spark, sf_dir)), "date")


@query("SELECT year(date) AS year, count(value) AS valid, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM returns WHERE value IS NOT NULL GROUP BY ALL", "mean min max")
def annual_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annual_profile(market.returns(market.panel(spark, sf_dir)))


@query("SELECT date, stock_code, value FROM returns WHERE value IS NOT NULL ORDER BY abs(value) DESC, date, stock_code LIMIT 20", "value")
def top_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_extremes(market.returns(market.panel(spark, sf_dir)))


@query("SELECT substr(stock_code, 1, 3) AS prefix, count(*) AS stocks FROM (SELECT DISTINCT stock_code FROM panel) GROUP BY 1 ORDER BY stocks DESC, prefix LIMIT 20")
def code_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prefix_counts(market.panel(spark, sf_dir).select("stock_code").distinct())


@query(f"SELECT \"column\", {_dist('v', QUANTILES)} FROM (SELECT unnest(['turnover', 'value']) AS \"column\", unnest([turnover, value]) AS v FROM panel JOIN returns USING (date, stock_code)) GROUP BY ALL", _dist_names(QUANTILES))
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return quality.distribution_stats(p.join(market.returns(p), ["date", "stock_code"]), ["turnover", "value"])


DAILY_QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)


@query(f"SELECT date, \"column\", {_dist('v', DAILY_QUANTILES)} FROM (SELECT date, unnest(['turnover', 'value']) AS \"column\", unnest([turnover, value]) AS v FROM panel JOIN returns USING (date, stock_code)) GROUP BY ALL", _dist_names(DAILY_QUANTILES))
def daily_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return quality.daily_distribution(p.join(market.returns(p), ["date", "stock_code"]), ["turnover", "value"])


@query(
    """SELECT horizon, count(*) AS n, median(e) AS median_error, quantile_cont(e, 0.9) AS p90_error, quantile_cont(e, 0.99) AS p99_error, count(*) FILTER (e < 0.0001) AS within_basis, count(*) FILTER (e < 0.0001) / count(*) AS within_basis_rate FROM (
      SELECT h AS horizon, abs(c2.market_cap / c.market_cap - 1 - value) AS e FROM returns JOIN (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY date) AS pos FROM panel) c USING (date, stock_code)
      CROSS JOIN range(1, 31) t(h) JOIN (SELECT stock_code, market_cap, row_number() OVER (PARTITION BY stock_code ORDER BY date) AS pos FROM panel) c2 ON c2.stock_code = returns.stock_code AND c2.pos = c.pos + h WHERE value IS NOT NULL) GROUP BY horizon""",
    "median_error p90_error p99_error within_basis_rate",
)
def horizon_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return quality.horizon_errors(market.returns(p), p.select("date", "stock_code", F.col("market_cap").alias("close")), sample=None)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    history = _daily(spark, sf_dir)
    w = Window.partitionBy("stock_code").orderBy("date")
    history = history.withColumn("pct_change", (F.col("close") / F.lag("close").over(w) - 1) * 100)
    code = F.col("stock_code").cast("int")
    stocks = p.select("stock_code").distinct().select("stock_code", F.when(code % 3 == 0, F.lit(dt.date(1995, 6, 1))).alias("listing_date"), F.when(code % 7 == 0, F.lit(dt.date(2001, 6, 1))).alias("delist_date"))
    return quality.extreme_evidence(market.returns(p), history, _calendar(spark, sf_dir), stocks, 0.45)


EXTREMES = f"""{DAILY.rstrip()},
days AS (SELECT date, row_number() OVER (ORDER BY date) AS day_pos FROM calendar),
history AS (
  SELECT stock_code, date AS d, close, row_number() OVER w - 1 AS pos, close / lag(close) OVER w - 1 AS close_ret, greatest(day_pos - lag(day_pos) OVER w - 1, 0) AS gap_before
  FROM daily LEFT JOIN days USING (date) WINDOW w AS (PARTITION BY stock_code ORDER BY date)),
cases AS (SELECT date AS label_date, stock_code, value AS return_y, CASE WHEN CAST(stock_code AS INT) % 3 = 0 THEN DATE '1995-06-01' END AS listed, CASE WHEN CAST(stock_code AS INT) % 7 = 0 THEN DATE '2001-06-01' END AS delisted FROM returns WHERE abs(value) > 0.45),
bases AS (SELECT label_date, stock_code, min(pos) AS base_pos FROM cases JOIN history USING (stock_code) WHERE d >= label_date GROUP BY ALL),
events AS (
  SELECT * FROM (
    SELECT b.label_date, b.stock_code, h.d AS event_date, h.pos, h.close_ret, h.gap_before, CASE WHEN z.close <> 0 THEN h.close / z.close - 1 END AS cum_ret,
      row_number() OVER (PARTITION BY b.label_date, b.stock_code ORDER BY coalesce(abs(h.close_ret), -1) DESC, h.pos) AS k
    FROM bases b JOIN history z ON z.stock_code = b.stock_code AND z.pos = b.base_pos JOIN history h ON h.stock_code = b.stock_code AND h.pos BETWEEN b.base_pos AND b.base_pos + 5) WHERE k = 1),
flagged AS (
  SELECT *, list_filter([
    CASE WHEN pos <= 5 THEN 'new_listing_first_days' WHEN pos <= 60 THEN 'recent_listing_first_60_trading_days' END,
    CASE WHEN label_date < listed AND listed - label_date BETWEEN 1 AND 10 THEN 'label_shifted_before_listing_event' END,
    CASE WHEN delisted - event_date BETWEEN -5 AND 90 THEN 'delisting_period_or_pre_delisting_trade' END,
    CASE WHEN gap_before >= 20 THEN 'resumption_after_long_suspension' WHEN gap_before >= 5 THEN 'resumption_after_short_suspension' END,
    CASE WHEN (coalesce(abs(close_ret) >= 0.4, false) OR coalesce(abs(cum_ret) >= 0.4, false)) AND abs(close_ret) * 100 < 20 THEN 'unadjusted_price_discontinuity_ex_rights_or_corporate_action'
      WHEN abs(close_ret) * 100 >= 50 THEN 'single_day_raw_price_jump_over_50pct' WHEN abs(close_ret) * 100 >= 20 THEN 'single_day_raw_price_jump_20_to_50pct' END,
    CASE WHEN coalesce(abs(close_ret - return_y) < 0.02, false) OR coalesce(abs(cum_ret - return_y) < 0.02, false) THEN 'label_matches_local_raw_move' END], lambda x: x IS NOT NULL) AS flags,
    stock_code IN (SELECT stock_code FROM history) AS has_history
  FROM cases LEFT JOIN events USING (label_date, stock_code)),
ruled AS (
  SELECT *, CASE
    WHEN NOT has_history THEN 'missing_local_daily_history' WHEN pos IS NULL THEN 'pre_listing_or_no_trading_record_on_label_date' WHEN len(flags) = 0 THEN 'unexplained_by_local_daily_metadata'
    WHEN list_contains(flags, 'delisting_period_or_pre_delisting_trade') AND list_has_any(flags, ['single_day_raw_price_jump_over_50pct', 'resumption_after_long_suspension', 'resumption_after_short_suspension']) THEN 'delisting_or_resumption_extreme_trade'
    WHEN list_has_all(flags, ['new_listing_first_days', 'label_shifted_before_listing_event']) THEN 'new_listing_label_shift'
    WHEN list_contains(flags, 'new_listing_first_days') THEN 'new_listing_first_days'
    WHEN list_contains(flags, 'unadjusted_price_discontinuity_ex_rights_or_corporate_action') THEN 'corporate_action_unadjusted_price_discontinuity'
    WHEN list_contains(flags, 'resumption_after_long_suspension') THEN 'resumption_after_long_suspension' WHEN list_contains(flags, 'resumption_after_short_suspension') THEN 'resumption_after_short_suspension'
    WHEN list_contains(flags, 'single_day_raw_price_jump_over_50pct') THEN 'large_raw_price_move' ELSE flags[1] END AS primary_cause FROM flagged),
classified AS (
  SELECT label_date, stock_code, return_y, event_date, close_ret AS event_close_ret, gap_before, cum_ret, primary_cause,
    CASE WHEN primary_cause IN ('missing_local_daily_history', 'pre_listing_or_no_trading_record_on_label_date', 'unexplained_by_local_daily_metadata', 'delisting_or_resumption_extreme_trade', 'corporate_action_unadjusted_price_discontinuity') THEN 'High' ELSE 'Medium' END AS severity,
    concat_ws('; ', nullif(array_to_string(flags, '; '), ''), CASE WHEN event_date <> label_date THEN 'event on ' || event_date || ', label on ' || label_date END) AS explanation FROM ruled)
"""


@query("SELECT * FROM classified", "return_y event_close_ret cum_ret", EXTREMES)
def extreme_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.classify_extremes(_evidence(spark, sf_dir))
    return df.select("label_date", "stock_code", "return_y", "event_date", "event_close_ret", "gap_before", "cum_ret", "primary_cause", "severity", "explanation")


@query(
    "SELECT primary_cause, severity, count(*) AS cases, avg(abs(return_y)) AS mean_abs, median(abs(return_y)) AS median_abs, max(abs(return_y)) AS max_abs FROM classified GROUP BY ALL",
    "mean_abs median_abs max_abs",
    EXTREMES,
)
def extreme_cause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cause_counts(quality.classify_extremes(_evidence(spark, sf_dir)))


@query()
def symbol_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    r = market.returns(p)
    return neutralize.symbol_examples(r, neutralize.neutralize(r, p))


# ---- series

@query("SELECT date, stock_code, turnover, coalesce(CASE WHEN stddev_pop(turnover) OVER s > 1e-12 THEN (turnover - avg(turnover) OVER s) / stddev_pop(turnover) OVER s END, 0.0) AS turnover_z FROM panel WINDOW s AS (PARTITION BY stock_code)", "turnover turnover_z")
def series_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.series_z(market.panel(spark, sf_dir).select("date", "stock_code", "turnover"), "turnover")


@query("SELECT \"column\", count(v) AS count, avg(v) AS mean, min(v) AS min, median(v) AS median, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, max(v) AS max FROM (SELECT unnest(['turnover', 'value']) AS \"column\", unnest([turnover, value]) AS v FROM panel LEFT JOIN returns USING (date, stock_code)) GROUP BY ALL", "mean min median p95 p99 max")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = market.panel(spark, sf_dir)
    return diagnose.series_summary(p.join(market.returns(p), ["date", "stock_code"], "left"), ["turnover", "value"])


@query("SELECT o_orderkey, s AS start, e AS \"end\", CASE WHEN e <= s THEN 0 ELSE (SELECT count(*) FROM calendar WHERE date > s AND date < e) END AS days_between FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 - 3 AS INT) AS e FROM orders)", "", DAILY)
def trading_days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders")
    spans = orders.select("o_orderkey", F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 40 - 3).cast("int")).alias("end"))
    return diagnose.trading_days_between(spans, _calendar(spark, sf_dir))


@query("SELECT 'index__' || name AS \"column\", count(*) FILTER (hit) AS rows_set, count(DISTINCT date) FILTER (hit) AS dates FROM (SELECT date, unnest(['CSI300', 'CSI500', 'CSI1000', 'CSI2000', 'NON_INDEX', 'UNKNOWN_INDEX']) AS name, unnest([is_csi300 = 1, is_csi500 = 1, is_csi1000 = 1, is_csi2000 = 1, is_csi300 + is_csi500 + is_csi1000 + is_csi2000 = 0, false]) AS hit FROM panel) GROUP BY name")
def one_hot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.one_hot_summary(panel.index_one_hot(market.panel(spark, sf_dir)))
