"""Readers: tables by suffix, matrices, dated datasets with a manifest, zipped histories, reference files. Market stores are in ``market``."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import assert_all, assert_matched, assert_unique, passing, require_columns
from ..functions.keys import finite, parsed_date, reference_board, stock_code
from ..operators.panel import wide_to_long


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, texts: Sequence[str] = ("stock_code",), schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or csv by suffix. A csv with a ``schema`` is scanned once; without one its types are inferred in a
    scan of its own, but its ``texts`` stay text. ``columns`` prunes the scan. Pickles are no Spark source: convert them once with ``import_pickle``."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        df = spark.read.format(kind).load(path)
    elif kind in ("csv", "txt"):
        head = spark.read.option("header", True)
        if schema is None:
            guess = head.option("inferSchema", True).csv(path)
            schema = ", ".join(f"`{f.name}` {'string' if f.name in texts else f.dataType.simpleString()}" for f in guess.schema)
        df = head.schema(schema).csv(path) if schema else head.csv(path)
    else:
        raise ValueError(f"can't read a table from {path!r}")
    if columns is not None:
        require_columns(df, columns, path)
        df = df.select(*columns)
    return df


def import_pickle(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A pickled pandas frame that the driver can open, written once as Parquet."""
    import pandas as pd

    frame = pd.read_pickle(path)
    spark.createDataFrame(frame.reset_index() if frame.index.name else frame).write.parquet(target)
    return spark.read.parquet(target)


def _csv_cells(line: Column) -> Column:
    """The cells of a csv line; those in quotes may hold commas, and quotes behind a backslash or doubled."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"\\]++|\\.|"")*+"|[^,]*)'), F.lit(1))
    bare = lambda c: F.when(c.rlike('^".*"$'), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r'\\(.)|"(")', "$1$2")).otherwise(c)
    return F.when(F.contains(line, F.lit('"')), F.transform(found, bare)).otherwise(F.split(line, ",", -1))


def _csv_matrix(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(date, stock_code, value) as text. A matrix may have more columns than a plan can, so lines are cut in their rows; the driver gets the header, as of any csv."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.first()
    if head is None:
        raise ValueError("the matrix has no columns")
    header = lines.sparkSession.createDataFrame([(head[0],)], "_head string").select("_head", F.slice(_csv_cells(F.col("_head")), 2, len(head[0]) + 1).alias("_names"))
    if not header.where(F.size("_names") > 0).count():
        raise ValueError("the matrix has no columns")
    cut = lines.crossJoin(F.broadcast(header)).where(F.col("value") != F.col("_head")).select("_names", _csv_cells(F.col("value")).alias("_cells"))  # one row
    pairs = F.arrays_zip(F.col("_names").alias("stock_code"), F.slice("_cells", 2, F.size("_names")).alias("v"))
    return cut.select(F.get("_cells", F.lit(0)).alias("date"), F.inline(pairs)).select("date", "stock_code", finite(F.col("v")).alias(value)).where(F.col(value).isNotNull())


def read_matrix(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """A date x stock matrix as rows (date, stock_code, value); the first column holds the dates. Dates and codes must be unique."""
    if path.rstrip("/").lower().endswith((".csv", ".txt")):
        long = _csv_matrix(spark, path, value)
    else:
        wide = read_table(spark, path)
        long = wide_to_long(wide, wide.columns[0], value).withColumnRenamed(wide.columns[0], "date")
    out = long.select(parsed_date(F.col("date")).alias("date"), stock_code(F.col("stock_code")).alias("stock_code"), value)
    assert_all(out, F.col("date").isNotNull(), "the matrix has rows without a date")
    assert_unique(out, ["date", "stock_code"], "the matrix")
    return out


def read_dated(spark: SparkSession, manifest: DataFrame, root: str, start: str | None = None, end: str | None = None, numeric: Sequence[str] = ()) -> DataFrame:
    """The csv partitions that a manifest (date, file_path) lists between two dates, in one scan; each may hold its own date only.

    Paths are relative to ``root``. Rows are told apart by the whole relative path, in a join with the manifest. The driver gets the
    list of paths, a row for each date; a row of another date than its partition's stops the query.
    """
    days = manifest.select(parsed_date(F.col("date")).alias("_date"), F.col("file_path").alias("_path"))
    assert_unique(days, ["_date"], "the manifest")
    if start:
        days = days.where(F.col("_date") >= F.lit(start).cast("date"))
    if end:
        days = days.where(F.col("_date") <= F.lit(end).cast("date"))
    listed = days.collect()
    if not listed:
        raise ValueError("the manifest lists no partition in the range")
    base = root.rstrip("/")
    df = spark.read.option("header", True).csv([f"{base}/{r['_path']}" for r in listed])
    at = "trade_date" if "trade_date" in df.columns else "date"
    # the path of a row ends with /root/relative; the name that Spark gives may have a scheme, a host and escapes
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", base)
    name = F.try_url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B"))
    df = df.withColumn("_path", F.substring_index(name, f"{below}/", -1)).withColumn("date", parsed_date(F.col(at)))
    own = spark.createDataFrame(listed, days.schema)
    joined = passing(df.join(own, "_path", "left"), F.col("date") == F.col("_date"), "a partition holds rows of another date", ["_path", "date"])
    return joined.withColumns({c: finite(F.col(c)) for c in numeric}).drop("_path", "_date")


def select_universe(df: DataFrame, universe: DataFrame | None) -> DataFrame:
    """The rows of the universe's keys, every one of which must be there; all rows without a universe."""
    if universe is None:
        return df
    keys = ["date", "stock_code"]
    assert_matched(universe.select("date").distinct(), df, ["date"], "universe dates without data")
    assert_matched(universe, df, keys, "universe rows without data")
    return df.join(universe.select(*keys), keys, "left_semi")


def read_zipped_csv(spark: SparkSession, path: str, columns: Mapping[str, str], encoding: str = "utf-8-sig") -> DataFrame:
    """Rows of all csv members of the zip files at ``path``: member name, and the ``columns`` (name to new name) as text.

    Archives are the unit of parallel work; members are read as streams.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_names = ["archive", "member", *columns.values()]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=out_names)

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not member.endswith(".csv"):
                            continue
                        with z.open(member) as f:
                            for row in csv.DictReader(io.TextIOWrapper(f, encoding)):
                                rows.append((archive, member, *[row.get(n) for n in names]))
                                if len(rows) >= 5000:
                                    yield packed(rows)
                                    rows = []
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in ("archive", "member", *columns.values())))


def read_stock_histories(spark: SparkSession, path: str) -> DataFrame:
    """Daily histories of zip files with a csv per stock: date, stock_code, market cap, amount, volume, turnover, close."""
    # fixed values: the source's column names
    columns = {"交易日期": "trade_date", "总市值(万元)": "market_cap", "成交额(千元)": "amount_k", "成交量(手)": "volume", "换手率": "turnover", "收盘价": "close", "涨跌幅": "pct_change"}
    raw = read_zipped_csv(spark, path, columns)
    numbers = {c: finite(F.col(c)) for c in columns.values() if c != "trade_date"}
    df = raw.withColumns(numbers).withColumn("date", parsed_date(F.col("trade_date"))).withColumn("stock_code", F.substring("member", 1, 6))
    w = Window.partitionBy("stock_code").orderBy("date")
    return df.where("date is not null").withColumn("close_return", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).drop("archive", "member", "trade_date")


def read_snapshots(spark: SparkSession, path: str, code_column: str) -> DataFrame:
    """Index snapshots from zip files whose names begin with their date: (snapshot_date, stock_code)."""
    raw = read_zipped_csv(spark, path, {code_column: "code"})
    day = F.regexp_extract(F.element_at(F.split("archive", "/"), -1), "^([0-9]{8})", 1)
    return raw.select(F.try_to_date(day, "yyyyMMdd").alias("snapshot_date"), stock_code(F.col("code")).alias("stock_code")).where("snapshot_date is not null").distinct()


def first_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[c.strip().lower()] for c in candidates if c.strip().lower() in by_name), None)


def read_board_reference(df: DataFrame) -> DataFrame:
    """(stock_code, reference_board) of a listing-board reference with any of the usual column names; the last row of a code wins."""
    code = first_column(df.columns, ["stock_code", "ts_code", "TS代码", "股票代码"])
    board = [c for c in (first_column(df.columns, ["listing_board_code", "board_code"]), first_column(df.columns, ["listing_board", "board", "市场类型"])) if c]
    exchange = first_column(df.columns, ["exchange", "exchange_code", "交易所代码"])
    if code is None or not board:
        raise ValueError("the reference needs a stock code and a listing board")
    at = F.col(exchange) if exchange else F.lit(None).cast("string")
    found = F.coalesce(*[F.when((b := reference_board(F.col(c), at)) != "", b) for c in board])
    rows = df.withColumn("_k", F.monotonically_increasing_id()).select(stock_code(F.col(code)).alias("stock_code"), found.alias("reference_board"), "_k")
    last = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("_k")))
    return rows.where("stock_code <> '' and reference_board is not null").withColumn("_n", last).where("_n = 1").select("stock_code", "reference_board")


def static_metadata(stocks: DataFrame, industry: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Per stock: industry (of the industry table, else of the list) and board (of the reference, else inferred), with the board's source."""
    from ..functions.keys import UNKNOWN_INDUSTRY, category, inferred_board

    df = stocks.select(stock_code(F.col("stock_code")).alias("stock_code"), category(F.col("industry")).alias("_list"), "market_type", "exchange")
    df = df.join(industry.select(stock_code(F.col("stock_code")).alias("stock_code"), category(F.col("industry")).alias("_own")), "stock_code", "left")
    df = df.withColumn("industry", F.coalesce("_own", "_list", F.lit(UNKNOWN_INDUSTRY))).withColumn("_b", inferred_board(F.col("stock_code"), F.col("market_type"), F.col("exchange")))
    if boards is None:
        return df.select("stock_code", "industry", F.col("_b.board").alias("board"), F.col("_b.source").alias("board_source"))
    df = df.join(boards, "stock_code", "left")
    return df.select("stock_code", "industry", F.coalesce("reference_board", "_b.board").alias("board"), F.when(F.col("reference_board").isNotNull(), "listing_board_reference").otherwise(F.col("_b.source")).alias("board_source"))


def read_gbk_table(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A tab-separated GBK text without header. Lines are cut as bytes, as no byte of a GBK letter is a tab or a line end, and decoded by executors."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line.decode("gbk", "replace").split("\t") for line in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) and r[i] != "" else None for r in rows], pa.string()) for i in range(len(names))], names=list(names))

    # the text source hands on a line's bytes as they are
    lines = spark.read.text(path).where("value <> ''").select(F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(decoded, ", ".join(f"`{n}` string" for n in names))
