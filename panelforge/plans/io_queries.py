"""Queries through the sources and sinks: what was written is read again, whole, and held against the tables it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import checkpointed, forget, shared_path, stored
from ..operators import diagnose, evaluate, nav, neutralize, panel, periods
from ..sources import bundles, market as stores, readers, writers
from . import market
from .registry import query
from .score_queries import BUCKETS, FEATURES, IC, PAIRS, RANKED, SCORES, SPREAD, WITHIN, _features

PANEL = "date, stock_code, industry, board, is_csi300, is_csi500, is_csi1000, is_csi2000, market_cap, volume, amount_k, turnover, alpha"
NUMBERS = "market_cap volume amount_k turnover alpha"


@query(f"SELECT {PANEL} FROM panel", NUMBERS, digits=9)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as csv in key order, with ISO dates, and back with its types."""
    p, path = market.panel(spark, sf_dir), shared_path(spark, "panel") + ".csv"
    writers.write_csv(p, path, keys=["date", "stock_code"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema)
    return readers.read_table(spark, path, p.columns, schema=schema)


@query(f"SELECT {PANEL} FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", NUMBERS, digits=9)
def dated_csv_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions by date behind a manifest of their paths, read between two dates; each holds its own date only."""
    p, root = market.panel(spark, sf_dir), shared_path(spark, "daily")
    dated = writers.iso_dates(p.withColumn("day", F.col("date")))
    dated.repartition("day").write.partitionBy("day").option("header", True).csv(root)
    files = spark.read.option("header", True).csv(f"{root}/*/*.csv").select("date", F.input_file_name().alias("f")).distinct()  # a row per date
    manifest = files.select("date", F.concat_ws("/", F.slice(F.split("f", "/"), -2, 2)).alias("file_path"))
    out = readers.read_dated(spark, manifest, root, "1996-01-01", "1999-12-31", NUMBERS.split())
    return out.select(*[F.col(c).cast(t) for c, t in p.dtypes])


@query("SELECT date, stock_code, value FROM returns WHERE value IS NOT NULL", "value")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a matrix of dates and stocks, written as csv and read as rows again."""
    path = shared_path(spark, "matrix") + ".csv"
    writers.write_matrix(market.returns(market.panel(spark, sf_dir)).where("value is not null"), path)
    return readers.read_matrix(spark, path)


@query("SELECT date, stock_code, turnover AS value FROM panel", "value", digits=9)
def signal_in_either_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal matrix with stocks as rows: the axis that looks like dates is found."""
    rows = market.panel(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "stock_code", F.col("turnover").alias("value"))
    return panel.signal_to_long(panel.long_to_wide(rows, key="stock_code", name="date"), "value")


def _told(spark: SparkSession, kind: str, tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows and keys of a bundle's tables as its manifest has them, and whether the tables read back and dealt anew give the same digests."""
    root = shared_path(spark, name)
    first = bundles.write_bundle(spark, kind, tables, root)
    again = bundles.write_bundle(spark, kind, {n: df.repartition(3) for n, df in bundles.read_bundle(spark, root).items()}, root)
    rows = [(n, ",".join(t["keys"]), t["rows"], t["digest"] == again["tables"][n]["digest"]) for n, t in first["tables"].items()]
    return spark.createDataFrame(rows, "table string, keys string, rows long, same boolean")


def _counts(tables: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"""SELECT '{n}' AS "table", '{keys}' AS keys, ({sql}) AS rows, true AS same""" for n, (keys, sql) in tables.items())


SERIES, DAY = "fold_id,split,bucket_index", "fold_id,split,date"


@query(
    _counts({
        "daily_returns": (f"{SERIES},date", "SELECT count(*) FROM daily"),
        "nav": (f"{SERIES},date", "SELECT count(*) FROM nav"),
        "summary": (SERIES, "SELECT count(DISTINCT (fold_id, split, bucket_index)) FROM nav"),
        "constituents": (f"{SERIES},date,stock_code", "SELECT count(*) FROM bucketed"),
        "industry_daily": (f"{SERIES},date,industry", "SELECT count(*) FROM (SELECT DISTINCT fold_id, split, date, bucket_index FROM bucketed) JOIN (SELECT DISTINCT fold_id, split, date, industry FROM ranked JOIN panel USING (date, stock_code)) USING (fold_id, split, date)"),
        "industry_summary": (f"{SERIES},industry", "SELECT count(DISTINCT (b.fold_id, b.split, b.bucket_index, industry)) FROM (SELECT DISTINCT fold_id, split, date, bucket_index FROM bucketed) b JOIN (SELECT DISTINCT fold_id, split, date, industry FROM ranked JOIN panel USING (date, stock_code)) USING (fold_id, split, date)"),
        "size_daily": (f"{SERIES},date,metric", "SELECT 5 * count(DISTINCT (fold_id, split, date, bucket_index)) FROM bucketed"),
        "size_summary": (f"{SERIES},metric", "SELECT 5 * count(DISTINCT (fold_id, split, bucket_index)) FROM bucketed"),
        "size_decile_daily": (f"{SERIES},date,size_decile", "SELECT count(*) FROM (SELECT DISTINCT fold_id, split, date, bucket_index FROM bucketed) JOIN (SELECT DISTINCT fold_id, split, date, size_decile FROM ranked JOIN features USING (date, stock_code)) USING (fold_id, split, date)"),
    }),
    "",
    f"{RANKED.rstrip()},{FEATURES}",
)
def nav_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rank bucket tables of one score as a bundle."""
    # nine tables come from the same three
    p = checkpointed(market.panel(spark, sf_dir))
    pred, r, features = (checkpointed(df) for df in (market.predictions(p), market.returns(p), _features(p)))
    out = nav.rank_bucket_nav(pred, r, "pred_a", features, bucket_count=BUCKETS)
    return _told(spark, "rank_bucket_nav", out, "nav-bundle")


@query(
    _counts({
        "frame": (f"{DAY},stock_code", "SELECT count(*) FROM predictions"),
        "daily_ic": (f"{DAY},score_col", "SELECT count(*) FROM ic"),
        "ic_summary": ("fold_id,split,score_col", "SELECT count(DISTINCT (fold_id, split, score_col)) FROM ic"),
        "spread_by_date": (f"{DAY},score_col", "SELECT count(*) FROM spread"),
        "spread_summary": ("fold_id,split,score_col", "SELECT count(DISTINCT (fold_id, split, score_col)) FROM spread"),
    }),
    "",
    SPREAD.rstrip() + IC[len(PAIRS.rstrip()) :],
)
def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of an evaluation as a bundle, for a panel that has no dimensions to group by."""
    p = checkpointed(market.panel(spark, sf_dir))
    pred = checkpointed(market.predictions(p).join(market.returns(p), ["date", "stock_code"], "left"))
    return _told(spark, "model_evaluation", evaluate.evaluate_discovered(pred, p.select("date", "stock_code"), SCORES, "value"), "evaluation-bundle")


@query(
    _counts({
        "panel": ("date,stock_code", "SELECT count(*) FROM labelled"),
        "fold_assignments": ("fold_id,date", "SELECT count(*) FROM folds WHERE date IN (SELECT date FROM labelled)"),
        "label_distribution": ("date", "SELECT count(DISTINCT date) FROM labelled"),
        "feature_diagnostics": ("feature,date", "SELECT 2 * count(DISTINCT date) FROM labelled"),
        "split_summary": ("fold_id,split", "SELECT 9"),
        "signal_diagnostics": ("signal", "SELECT 1"),
    }),
    "",
    "labelled AS (SELECT date, stock_code FROM panel JOIN returns USING (date, stock_code) WHERE value IS NOT NULL AND alpha > 0)",
)
def training_data_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training panel with folds, label and feature diagnostics and split summary as a bundle."""
    from .table_queries import _alpha_panel

    built = checkpointed(_alpha_panel(spark, sf_dir))
    folds = panel.fold_assignments(built.select("date"), market.FOLDS)
    tables = {
        "panel": built,
        "fold_assignments": folds,
        "label_distribution": panel.label_distribution(built, ["y_raw_fwd", "y_raw_rank_label"]),
        "feature_diagnostics": panel.feature_diagnostics(built, ["alpha_signal_z", "turnover_z"]),
        "split_summary": panel.split_summary(built, folds),
        "signal_diagnostics": panel.signal_diagnostics(built, ["alpha_signal"]),
    }
    return _told(spark, "non_neutralized_training", tables, "training-bundle")


@query(
    f"SELECT {PANEL}, ln(market_cap) AS size_raw FROM panel WHERE turnover > 0.05",
    f"{NUMBERS} size_raw",
    digits=9,
)
def raw_feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw features of a universe with a raw signal, exported as a bundle and read from it."""
    root = shared_path(spark, "raw-features")
    p, own = stored(market.panel(spark, sf_dir), "market")  # context, signal and universe come from it
    signal = p.select("date", "stock_code", F.log("market_cap").alias("value"))
    bundles.export_raw_features(spark, p, {"size": signal}, root, p.where("turnover > 0.05").select("date", "stock_code"))
    forget(spark, own)
    return bundles.read_bundle(spark, root)["raw_training_features"]


@query(
    """SELECT date, stock_code, CASE WHEN industry IN ('FRANCE', 'GERMANY') THEN 2.0 ELSE 1.0 END * volume AS factor FROM panel
    WHERE month(date) % 2 = CASE WHEN board = 'ASIA' THEN 0 ELSE 1 END AND board IN ('ASIA', 'EUROPE')""",
    "factor",
)
def market_store_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment factors on the trading days of each stock's own exchange: the even months in one, the odd ones in the other."""
    p = market.panel(spark, sf_dir)
    months = p.select("date").distinct().withColumn("exchange", F.explode(F.array(F.lit("SSE"), F.lit("SZSE"))))
    calendar = months.withColumn("is_open", (F.month("date") % 2 == F.when(F.col("exchange") == "SSE", 0).otherwise(1)).cast("int"))
    scale = F.when(F.col("industry").isin("FRANCE", "GERMANY"), 2.0).otherwise(1.0)
    kinds = F.explode(F.array(F.struct(F.lit("hfq").alias("adjustment"), (scale * F.col("volume")).alias("factor")), F.struct(F.lit("qfq").alias("adjustment"), F.lit(0.0).alias("factor"))))
    factors = p.select("date", "stock_code", "board", kinds.alias("_k")).select("date", "stock_code", "board", "_k.*")
    store = stores.TableStore(calendar, factors, p.select("stock_code").distinct())
    own = [store.factors("hfq").where(F.col("board") == b).join(store.trading_days(e), "date", "left_semi") for b, e in (("ASIA", "SSE"), ("EUROPE", "SZSE"))]
    return own[0].unionByName(own[1]).select("date", "stock_code", "factor")


@query(
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, CASE WHEN s_suppkey % 3 = 0 THEN n_name WHEN s_suppkey % 3 = 1 THEN 'listed' ELSE 'Unknown Industry' END AS industry,
      CASE WHEN s_suppkey % 2 = 0 THEN 'STAR' ELSE 'SSE_MAIN' END AS board, CASE WHEN s_suppkey % 2 = 0 THEN 'listing_board_reference' ELSE 'exchange_market_mapping' END AS board_source
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def static_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry and board of every stock: of the industry table, else the list's; of the reference, else inferred."""
    from ..functions.keys import UNKNOWN_INDUSTRY

    s = market.table(spark, sf_dir, "supplier").join(market.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    stocks = s.select(k.cast("string").alias("stock_code"), F.when(k % 3 == 1, "listed").alias("industry"), F.lit("主板").alias("market_type"), F.lit("SH").alias("exchange"))
    industry = s.where(k % 3 == 0).select(k.cast("string").alias("stock_code"), F.col("n_name").alias("industry"))
    reference = readers.read_board_reference(s.where(k % 2 == 0).select(k.cast("string").alias("ts_code"), F.lit("STAR").alias("listing_board_code")))
    out = readers.static_metadata(stocks, industry, reference)
    return out.withColumn("industry", F.when(F.col("industry") == UNKNOWN_INDUSTRY, "Unknown Industry").otherwise(F.col("industry")))


@query(f"SELECT {PANEL} FROM panel WHERE stock_code IN (SELECT stock_code FROM panel GROUP BY 1 HAVING sum(volume) > 1500) AND date >= DATE '1996-01-01'", NUMBERS, digits=9)
def universe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a universe's rows; all of them must be there and be there once."""
    p = market.panel(spark, sf_dir)
    large = p.groupBy("stock_code").agg(F.sum("volume").alias("v")).where("v > 1500").select("stock_code")
    wanted = p.where("date >= '1996-01-01'").join(large, "stock_code", "left_semi").select("date", "stock_code")
    return panel.restrict_to_universe(readers.select_universe(p, wanted), wanted)


@query(
    """SELECT stock_code, coverage, raw_std, residual_std, round(raw_std - residual_std, 10) AS reduction FROM (
      SELECT stock_code, count(b) AS coverage, stddev_pop(a) AS raw_std, stddev_pop(b) AS residual_std FROM (
        SELECT stock_code, value AS a, value - avg(value) OVER (PARTITION BY date) AS b FROM returns WHERE value IS NOT NULL) GROUP BY 1)
    ORDER BY reduction DESC, coverage DESC, stock_code LIMIT 6""",
    "raw_std residual_std reduction",
    digits=6,
)
def example_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stocks to show: those whose deviation a transform lowers most (here: the date's mean taken off)."""
    from pyspark.sql import Window

    r = market.returns(market.panel(spark, sf_dir)).where("value is not null")
    residual = r.select("date", "stock_code", (F.col("value") - F.avg("value").over(Window.partitionBy("date"))).alias("residual"))
    return diagnose.example_stocks(r, residual)


@query("SELECT period, printf('%02d', bucket_index) AS bucket, arg_max(gross_nav, date) AS nav, least(min(drawdown), 0.0) AS max_drawdown FROM period_nav GROUP BY ALL", "nav max_drawdown", WITHIN, 6)
def requested_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period table as reports show it."""
    p = market.panel(spark, sf_dir)
    daily = nav.bucket_returns(nav.rank_scores(market.predictions(p), "pred_a"), market.returns(p), BUCKETS)
    return periods.requested_metrics(periods.period_summary(daily, market.PERIODS)).select("period", "bucket", "nav", "max_drawdown")


@query(
    "SELECT date, max(abs(m)) AS largest_group_mean FROM (SELECT date, board, avg(e) AS m FROM (SELECT date, board, value - avg(value) OVER (PARTITION BY date) AS e FROM returns JOIN panel USING (date, stock_code) WHERE value IS NOT NULL) GROUP BY ALL) GROUP BY date",
    "largest_group_mean",
)
def largest_board_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mean that a board keeps by date when only the date's mean is taken off."""
    from pyspark.sql import Window

    p = market.panel(spark, sf_dir)
    r = market.returns(p).where("value is not null")
    return neutralize.largest_group_mean(r.withColumn("residual", F.col("value") - F.avg("value").over(Window.partitionBy("date"))), p, "board")
