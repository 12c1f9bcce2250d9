"""A date x stock market derived from the star-schema tables, on which the registered queries run.

Suppliers are stocks and months are dates. Measures are sums of exact decimals (means of them are rounded),
so ranks do not depend on the order of addition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.panel import Fold
from ..operators.periods import Period

FOLDS = (
    Fold(1, (dt.date(1995, 1, 1), dt.date(1996, 12, 31)), (dt.date(1997, 1, 1), dt.date(1997, 12, 31)), (dt.date(1998, 1, 1), dt.date(1998, 12, 31))),
    Fold(2, (dt.date(1995, 1, 1), dt.date(1997, 12, 31)), (dt.date(1998, 1, 1), dt.date(1998, 12, 31)), (dt.date(1999, 1, 1), dt.date(1999, 12, 31))),
    Fold(3, (dt.date(1995, 1, 1), dt.date(1998, 12, 31)), (dt.date(1999, 1, 1), dt.date(1999, 12, 31)), (dt.date(2000, 1, 1), dt.date(2001, 12, 31))),
)
PERIODS = (
    Period("p1998", dt.date(1998, 1, 1), dt.date(1998, 12, 31)),
    Period("p1999", dt.date(1999, 1, 1), dt.date(1999, 12, 31)),
    Period("p2000", dt.date(2000, 1, 1), dt.date(2001, 12, 31)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, stock_code, industry, board, four index flags, market_cap, volume, amount_k, turnover, alpha."""
    items = table(spark, sf_dir, "lineitem")
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(18,2)")
    sums = items.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum(price).cast("double").alias("market_cap"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"),
        F.sum(price * discount).cast("double").alias("amount_k"),
        F.round(F.sum(discount).cast("double") / F.count("*"), 9).alias("turnover"),
        (F.sum(F.col("l_tax").cast("decimal(18,2)") * price).cast("double")).alias("alpha"),
    )
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rest = F.col("s_suppkey") % 5
    flags = [(rest == i).cast("int").alias(c) for i, c in enumerate(("is_csi300", "is_csi500", "is_csi1000", "is_csi2000"))]
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    return sums.join(dim, "s_suppkey").select("date", code.alias("stock_code"), F.col("n_name").alias("industry"), F.col("r_name").alias("board"), *flags, "market_cap", "volume", "amount_k", "turnover", "alpha")


def returns(p: DataFrame) -> DataFrame:
    """(date, stock_code, value): the next month's market cap over this one's, less 1, held within one half."""
    nxt = F.lead("market_cap").over(Window.partitionBy("stock_code").orderBy("date"))
    value = F.least(F.greatest(nxt / F.col("market_cap") - 1, F.lit(-0.5)), F.lit(0.5))
    return p.select("date", "stock_code", F.when(nxt.isNotNull(), value).alias("value"))


def predictions(p: DataFrame) -> DataFrame:
    """fold_id, split, date, stock_code and two scores: alpha and volume of the month before; every eleventh pred_b is missing."""
    w = Window.partitionBy("stock_code").orderBy("date")
    hole = F.col("stock_code").cast("int") % 11 == 0
    df = p.select("date", "stock_code", F.lag("alpha").over(w).alias("pred_a"), F.when(~hole, F.lag("volume").over(w)).alias("pred_b")).where("pred_a is not null")
    from ..operators.panel import fold_assignments

    folds = fold_assignments(p.select("date").distinct(), FOLDS)
    return df.join(F.broadcast(folds), "date").where("split <> 'train'")  # a row per month and fold


#: The same frames as common table expressions of DuckDB.
SQL = """
panel AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code,
    n_name AS industry, r_name AS board,
    CAST(l_suppkey % 5 = 0 AS INT) AS is_csi300, CAST(l_suppkey % 5 = 1 AS INT) AS is_csi500,
    CAST(l_suppkey % 5 = 2 AS INT) AS is_csi1000, CAST(l_suppkey % 5 = 3 AS INT) AS is_csi2000,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS market_cap,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS amount_k,
    round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*), 9) AS turnover,
    CAST(sum(CAST(l_tax AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS alpha
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
returns AS (
  SELECT date, stock_code, CASE WHEN nxt IS NOT NULL THEN least(greatest(nxt / market_cap - 1, -0.5), 0.5) END AS value
  FROM (SELECT *, lead(market_cap) OVER (PARTITION BY stock_code ORDER BY date) AS nxt FROM panel)),
fold_ranges(fold_id, split, lo, hi) AS (VALUES
  (1::BIGINT, 'train', DATE '1995-01-01', DATE '1996-12-31'), (1, 'valid', DATE '1997-01-01', DATE '1997-12-31'), (1, 'test', DATE '1998-01-01', DATE '1998-12-31'),
  (2, 'train', DATE '1995-01-01', DATE '1997-12-31'), (2, 'valid', DATE '1998-01-01', DATE '1998-12-31'), (2, 'test', DATE '1999-01-01', DATE '1999-12-31'),
  (3, 'train', DATE '1995-01-01', DATE '1998-12-31'), (3, 'valid', DATE '1999-01-01', DATE '1999-12-31'), (3, 'test', DATE '2000-01-01', DATE '2001-12-31')),
periods(period, lo, hi) AS (VALUES ('p1998', DATE '1998-01-01', DATE '1998-12-31'), ('p1999', DATE '1999-01-01', DATE '1999-12-31'), ('p2000', DATE '2000-01-01', DATE '2001-12-31')),
folds AS (SELECT fold_id, split, date FROM (SELECT DISTINCT date FROM panel) JOIN fold_ranges ON date BETWEEN lo AND hi),
predictions AS (
  SELECT fold_id, split, date, stock_code, pred_a, pred_b FROM (
    SELECT date, stock_code, lag(alpha) OVER w AS pred_a, CASE WHEN CAST(stock_code AS INT) % 11 <> 0 THEN lag(volume) OVER w END AS pred_b
    FROM panel WINDOW w AS (PARTITION BY stock_code ORDER BY date)) JOIN folds USING (date)
  WHERE pred_a IS NOT NULL AND split <> 'train')"""
