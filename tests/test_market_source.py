"""The market data source over a client that keeps files, and the readers of dated partitions."""

import datetime as dt
import re
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.sources import market, readers

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(10)]
SYMBOLS = {"000001": "000001.SZ", "000002": None, "600003": "600003.SH", "600004": "600004.SH", "830005": None, "x": None}


def file_client(folder: str):
    """Made inside a function, as executors can't import the tests."""

    class FileClient:
        """A client over a folder that notes what it was asked for."""

        def __init__(self, folder: str):
            self.folder = Path(folder)

        def _note(self, *words):
            with open(self.folder / "asked.txt", "a") as f:
                f.write(" ".join(words) + "\n")

        def trading_calendar(self, exchange, is_open, columns):
            self._note("calendar", exchange)
            return pd.read_csv(self.folder / f"calendar_{exchange}.csv")

        def stocks(self, include_delisted, columns):
            return pd.read_csv(self.folder / "stocks.csv", dtype=str)

        def technical_factors(self, symbol, adjustment, columns):
            self._note("factors", symbol, adjustment)
            return pd.read_csv(self.folder / f"{symbol}_{adjustment}.csv")

    return FileClient(folder)


@pytest.fixture
def folder(spark, tmp_path):
    for k, exchange in enumerate(("SSE", "SZSE", "BSE")):
        pd.DataFrame({"date": [*D[k:8], D[7], "no date"]}).to_csv(tmp_path / f"calendar_{exchange}.csv", index=False)
    listed = [*SYMBOLS.items(), ("000001", "second")]
    pd.DataFrame({"stock_code": [c for c, _ in listed], "symbol": [s for _, s in listed]}).to_csv(tmp_path / "stocks.csv", index=False)
    for code, symbol in SYMBOLS.items():
        name = symbol or market.symbol_for(code)
        for j, adjustment in enumerate(("hfq", "qfq")):
            if name:
                rows = [(d, (k + 1) * 10.0**j, k) for k, d in enumerate(D)] + [(D[2], 99.0, "bad")]  # a date again: the last counts
                pd.DataFrame(rows, columns=["trade_date", "adjustment_factor", "pct_change"]).to_csv(tmp_path / f"{name}_{adjustment}.csv", index=False)
    path = str(tmp_path)
    make = file_client
    make.__module__ = "__main__"  # sent whole, not by name
    market.register(spark, "market_test", lambda: make(path))
    return tmp_path


def asked(folder):
    path = folder / "asked.txt"
    out = sorted(set(path.read_text().split("\n")) - {""}) if path.exists() else []
    path.write_text("")
    return out


def test_filters_reach_the_source(spark, folder):
    store = market.ClientStore(spark, "market_test")
    got = store.factors("qfq").where((F.col("date") >= D[1]) & (F.col("date") < D[4])).where(F.col("stock_code").isin("600003", "000001"))
    rows = sorted((r.stock_code, r.symbol, r.adjustment, r.date, r.factor, r.pct_change) for r in got.collect())
    assert [r[:4] for r in rows] == [(c, SYMBOLS[c], "qfq", d) for c in ("000001", "600003") for d in D[1:4]]
    assert [r[4] for r in rows[:3]] == [20.0, 99.0, 40.0] and [r[5] for r in rows[:3]] == [0.01, None, 0.03]
    assert asked(folder) == ["factors 000001.SZ qfq", "factors 600003.SH qfq"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan market_test" in plan and not re.search(r"\bFilter \(", plan)  # all of them were pushed


def test_stocks_that_are_not_wanted_are_no_partition(spark, folder):
    read = lambda: spark.read.format("market_test").option("table", "factors").option("stocksPartition", 1)
    whole = read().load()
    assert whole.rdd.getNumPartitions() == len(SYMBOLS) and {r[0] for r in whole.select("stock_code").distinct().collect()} == set(SYMBOLS) - {"x"}
    assert {r[0] for r in whole.select("adjustment").distinct().collect()} == {"hfq"}
    assert read().load().where(F.col("stock_code").isin("000002", "600004")).rdd.getNumPartitions() == 2
    assert read().load().where((F.col("stock_code") == "000002") & (F.col("stock_code") == "600004")).collect() == []
    assert read().option("adjustments", "hfq, qfq").load().count() == 2 * 5 * 10


def test_calendars_by_exchange_and_stocks_once(spark, folder):
    store = market.ClientStore(spark, "market_test")
    for k, exchange in enumerate(("SSE", "SZSE")):
        assert sorted(r.date for r in store.trading_days(exchange).collect()) == D[k:8]
    assert asked(folder) == ["calendar SSE", "calendar SZSE"]
    assert store.trading_days("NONE").schema.simpleString() == "struct<date:date>"
    got = [(r.stock_code, r.symbol) for r in store.stocks().orderBy("source_order").collect()]
    assert got == [(c, s or {"000002": "000002.SZ", "830005": "830005.BJ"}.get(c)) for c, s in SYMBOLS.items()]
    # what the source can't apply stays with Spark
    odd = spark.read.format("market_test").option("table", "stocks").load().where("symbol like '%.SH' and source_order > 2")
    assert [r.stock_code for r in odd.collect()] == ["600004"]
    with pytest.raises(Exception, match="unknown table"):
        spark.read.format("market_test").option("table", "other").load()


def test_factors_without_their_columns_stop(spark, folder):
    pd.DataFrame({"trade_date": [D[0]]}).to_csv(folder / "600003.SH_hfq.csv", index=False)
    with pytest.raises(PySparkException, match="lack columns"):
        market.ClientStore(spark, "market_test").factors().collect()


def test_table_stores_know_exchange_and_adjustment(spark):
    calendar = spark.createDataFrame([("SSE", D[0], "1"), ("SSE", D[1], "0"), ("SZSE", D[1], "true")], "exchange string, date date, is_open string")
    factors = spark.createDataFrame([(D[0], "000001", 2.0, "hfq"), (D[0], "000001", 0.5, "qfq")], "date date, stock_code string, factor double, adjustment string")
    stocks = spark.createDataFrame([("000001", "b", 1), ("000001", "a", 0)], "stock_code string, symbol string, source_order int")
    store = market.TableStore(calendar, factors, stocks)
    assert [[r.date for r in store.trading_days(e).collect()] for e in ("SSE", "SZSE", "BSE")] == [[D[0]], [D[1]], []]
    assert [store.factors(a).first().factor for a in ("hfq", "qfq")] == [2.0, 0.5] and store.stocks().first().symbol == "a"
    plain = market.TableStore(calendar.drop("exchange"), factors.where("adjustment = 'hfq'").drop("adjustment"), stocks)
    assert plain.trading_days("BSE").count() == 2 and plain.factors("qfq").count() == 1
    with pytest.raises(ValueError, match="factor"):
        market.TableStore(calendar, factors.drop("factor"), stocks)


def test_dated_partitions_are_told_apart_by_their_whole_path(spark, tmp_path):
    for d in D[:3]:
        at = tmp_path / f"date={d}" / "a b+c"
        at.mkdir(parents=True)
        (at / "part.csv").write_text(f"symbol,trade_date,change\n1,{d},0.5\n2,{d},x\n")
    manifest = spark.createDataFrame([(str(d), f"date={d}/a b+c/part.csv") for d in D[:3]], "date string, file_path string")
    out = readers.read_dated(spark, manifest, str(tmp_path), end=str(D[1]), numeric=["change"])
    assert sorted((r.symbol, r.date, r.change) for r in out.collect() if r.change) == [("1", D[0], 0.5), ("1", D[1], 0.5)] and out.count() == 4
    (tmp_path / f"date={D[0]}" / "a b+c" / "part.csv").write_text(f"symbol,trade_date,change\n1,{D[1]},0.5\n")
    with pytest.raises(PySparkException, match="another date"):
        readers.read_dated(spark, manifest, str(tmp_path)).collect()


def test_csv_with_a_schema_is_not_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text("stock_code,x\n000001,1\n000002,\n")
    assert readers.read_table(spark, str(tmp_path / "t.csv")).dtypes == [("stock_code", "string"), ("x", "int")]
    assert readers.read_table(spark, str(tmp_path / "t.csv"), schema="stock_code string, x double").collect()[0].x == 1.0
    (tmp_path / "gbk.txt").write_bytes("000001\t银行\t\n\n000002\t\\N\"x\n".encode("gbk"))
    assert [tuple(r) for r in readers.read_gbk_table(spark, str(tmp_path / "gbk.txt"), ["a", "b", "c"]).collect()] == [("000001", "银行", None), ("000002", '\\N"x', None)]
