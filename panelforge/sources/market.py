"""A market data client as a Spark data source.

A client knows calendars, stocks and, one symbol at a time, adjustment factors. ``register`` makes it a source: the driver asks only for
the list of stocks, ranges of stocks become partitions, and the executors open clients of their own and ask for their symbols. Filters
on exchange, adjustment, stock and date reach the source, so stocks that are not wanted are no partition and other exchanges
and adjustments are never asked for.

    register(spark, "market", connect)     # connect() -> client, run on driver and executors
    ClientStore(spark, "market").factors("hfq").where("date >= '2024-01-01'")
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.checks import require_columns
from ..functions.keys import parsed_date

EXCHANGES, ADJUSTMENTS = ("SSE", "SZSE", "BSE"), ("hfq",)
SCHEMAS = {
    "calendar": "exchange string, date date",
    "stocks": "stock_code string, symbol string, source_order int",
    "factors": "stock_code string, symbol string, adjustment string, date date, factor double, pct_change double",
}
STOCKS_A_PARTITION = 50
#: Which exchange a code belongs to by its first digit, where the client names no symbol.
MARKETS = {"6": "SH", "0": "SZ", "2": "SZ", "3": "SZ", "8": "BJ", "9": "BJ"}


class Client(Protocol):
    """What a client has to offer; frames are of pandas."""

    def trading_calendar(self, exchange: str, is_open: bool, columns: str) -> pd.DataFrame:
        """``date`` of the exchange's trading days."""

    def stocks(self, include_delisted: bool, columns: str) -> pd.DataFrame:
        """``stock_code`` and, if known, ``symbol``."""

    def technical_factors(self, symbol: str, adjustment: str, columns: str) -> pd.DataFrame:
        """``trade_date``, ``adjustment_factor`` and ``pct_change`` (in hundredths) of a symbol."""


@dataclass
class Stocks(InputPartition):
    """A range of stocks: (stock_code, symbol) in the client's order, beginning at ``first``."""

    first: int
    pairs: tuple[tuple[str, str | None], ...]


def symbol_for(code: str) -> str | None:
    """Dotted codes stay; others get the exchange of their first digit."""
    if "." in code:
        return code
    market = MARKETS.get(code[:1])
    return f"{code}.{market}" if market else None


def listed(client: Client) -> list[tuple[str, str | None]]:
    """Stocks with their symbols, the first of each code."""
    frame = client.stocks(include_delisted=True, columns="standard")
    if "stock_code" not in frame:
        return []
    frame = frame[frame["stock_code"].notna()].copy()
    symbols = frame["symbol"].where(frame["symbol"].notna(), None) if "symbol" in frame else [None] * len(frame)
    first: dict[str, str | None] = {}
    for code, symbol in zip(frame["stock_code"].astype(str), symbols, strict=True):
        if first.get(code) is None:
            first[code] = None if symbol is None else str(symbol)
    return [(code, symbol or symbol_for(code)) for code, symbol in first.items()]


class MarketReader(DataSourceReader):
    def __init__(self, connect: Callable[[], Client], table: str, options: Mapping[str, str]):
        self.connect, self.table = connect, table
        split = lambda key, default: tuple(x.strip() for x in options[key].split(",")) if options.get(key) else default
        self.wanted: dict[str, set[str] | None] = {"exchange": set(split("exchanges", EXCHANGES)), "adjustment": set(split("adjustments", ADJUSTMENTS)), "stock_code": None}
        self.per_partition = int(options.get("stockspartition", STOCKS_A_PARTITION))
        self.low, self.high = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  as Spark names it
        """Takes what it can apply whole; the others go back to Spark."""
        day = dt.timedelta(days=1)
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            own = name in self.wanted and name in SCHEMAS[self.table] and isinstance(f, (EqualTo, In))
            dated = name == "date" and self.table != "stocks" and isinstance(getattr(f, "value", None), dt.date)
            if own:
                values = {str(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                now = self.wanted[name]
                # an explicit wish replaces the defaults, and a second one narrows the first
                self.wanted[name] = values if now is None or name in ("exchange", "adjustment") and not getattr(self, f"_{name}", False) else now & values
                setattr(self, f"_{name}", True)
            elif isinstance(f, IsNotNull) and name in (*self.wanted, "date"):
                continue  # these never are
            elif dated and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif dated and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + day * isinstance(f, GreaterThan))
            elif dated and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - day * isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        if self.table == "calendar":
            return [InputPartition(x) for x in sorted(self.wanted["exchange"])]
        pairs = listed(self.connect())
        chunks = []
        for first in range(0, len(pairs), self.per_partition):
            own = tuple(p for p in pairs[first : first + self.per_partition] if self.wanted["stock_code"] is None or p[0] in self.wanted["stock_code"])
            if own:
                chunks.append(Stocks(first, own))
        return chunks or [Stocks(0, ())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        inside = lambda day: self.low <= day <= self.high
        if self.table == "calendar":
            days = pd.to_datetime(self.connect().trading_calendar(exchange=partition.value, is_open=True, columns="standard")["date"], errors="coerce")
            yield from ((partition.value, d) for d in sorted(set(days.dropna().dt.date)) if inside(d))
            return
        if self.table == "stocks":
            yield from ((code, symbol, partition.first + i) for i, (code, symbol) in enumerate(partition.pairs))
            return
        client = self.connect() if partition.pairs else None
        for code, symbol in partition.pairs:
            for adjustment in sorted(self.wanted["adjustment"]) if symbol else ():
                frame = client.technical_factors(symbol, adjustment=adjustment, columns="standard")
                missing = sorted({"trade_date", "adjustment_factor", "pct_change"} - set(frame.columns))
                if missing:
                    raise ValueError(f"the factors of {symbol} lack columns: {missing}")
                frame = frame.assign(date=pd.to_datetime(frame["trade_date"], errors="coerce").dt.date).dropna(subset=["date"]).drop_duplicates("date", keep="last").sort_values("date")
                numbers = zip(frame["date"], pd.to_numeric(frame["adjustment_factor"], errors="coerce"), pd.to_numeric(frame["pct_change"], errors="coerce") / 100, strict=True)
                yield from ((code, symbol, adjustment, d, _number(f), _number(p)) for d, f, p in numbers if inside(d))


def _number(x: float) -> float | None:
    return float(x) if pd.notna(x) and abs(x) != float("inf") else None


def register(spark: SparkSession, name: str, connect: Callable[[], Client]) -> None:
    """Make ``spark.read.format(name).option("table", ...)`` read what ``connect()`` clients offer.

    Tables are those of ``SCHEMAS``. Options: ``exchanges`` and ``adjustments`` (commas between; what is read without a filter) and
    ``stocksPartition``. Filters reach Python sources only where ``spark.sql.python.filterPushdown.enabled`` is set, so it is.
    """

    class Market(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _table(self) -> str:
            table = self.options.get("table", "factors")
            if table not in SCHEMAS:
                raise ValueError(f"unknown table {table!r}: {sorted(SCHEMAS)}")
            return table

        def schema(self) -> str:
            return SCHEMAS[self._table()]

        def reader(self, schema: StructType) -> MarketReader:
            return MarketReader(connect, self._table(), self.options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Market)


class MarketStore(Protocol):
    """What the operators ask of a market data store, as frames of all stocks."""

    def trading_days(self, exchange: str) -> DataFrame: ...

    def factors(self, adjustment: str) -> DataFrame: ...

    def stocks(self) -> DataFrame: ...


class ClientStore:
    """A market store over a registered source."""

    def __init__(self, spark: SparkSession, name: str):
        self._read = lambda table: spark.read.format(name).option("table", table).load()

    def trading_days(self, exchange: str = "SSE") -> DataFrame:
        return self._read("calendar").where(F.col("exchange") == exchange).select("date")

    def factors(self, adjustment: str = "hfq") -> DataFrame:
        return self._read("factors").where(F.col("adjustment") == adjustment)

    def stocks(self) -> DataFrame:
        return self._read("stocks")


class TableStore:
    """A market store over tables: calendar (date, is_open and, for more than one, exchange), factors (date, stock_code, factor and,
    for more than one, adjustment), stocks (stock_code, symbol, source_order)."""

    def __init__(self, calendar: DataFrame, factors: DataFrame, stocks: DataFrame):
        require_columns(calendar, ["date", "is_open"], "calendar")
        require_columns(factors, ["date", "stock_code", "factor"], "factors")
        self._calendar, self._factors, self._stocks = calendar, factors, stocks

    def trading_days(self, exchange: str = "SSE") -> DataFrame:
        """Open days; a calendar without ``exchange`` is that of all exchanges."""
        days = self._calendar.where(F.col("exchange") == exchange) if "exchange" in self._calendar.columns else self._calendar
        flag = F.lower(F.col("is_open").cast("string"))
        return days.where(flag.isin("1", "true", "是", "交易")).select(parsed_date(F.col("date")).alias("date")).distinct()

    def factors(self, adjustment: str = "hfq") -> DataFrame:
        """Factors of the adjustment; a table without ``adjustment`` holds one kind only."""
        return self._factors.where(F.col("adjustment") == adjustment) if "adjustment" in self._factors.columns else self._factors

    def stocks(self) -> DataFrame:
        """First row of each code, in the order of the listing status."""
        w = Window.partitionBy("stock_code").orderBy("source_order")
        return self._stocks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
