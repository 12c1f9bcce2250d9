"""All queries of the panel operators, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market import SQL

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
DIGITS = 8


def plain(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Whole numbers as long, doubles rounded (and without negative zero), so results compare between engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, doubles: str = "", ctes: str = "", digits: int = DIGITS) -> Callable[[Query], Query]:
    """Register a query under its function's name.

    ``sql`` is a DuckDB SELECT over the derived market's expressions (and ``ctes``); its columns named
    in ``doubles`` are rounded as ``plain`` rounds those of the frame.
    """

    def register(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir), digits)
        if sql:
            rounded = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            replaced = f" REPLACE ({rounded})" if rounded else ""
            more = f",\n{ctes.strip().rstrip(',')}" if ctes else ""
            _oracles[f.__name__] = f"WITH {SQL.strip()}{more}\nSELECT *{replaced} FROM ({sql.strip()})"
        return f

    return register


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def _load() -> None:
    from . import io_queries, score_queries, table_queries  # noqa: F401  they register themselves


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return queries()["rank_bucket_nav"](spark, sf_dir)
