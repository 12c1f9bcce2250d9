"""Checks that are part of the operators.

``passing``, ``unique`` and ``matched`` return the frame with the check inside its plan: rows that pass go on, the
first that fails stops the query with its message. They add no job and, where the frame is dealt by the keys or
a part of them already, no shuffle. The optimiser leaves them where they are written: it moves no predicate that is not
deterministic, so a check above a join sees the rows that the join lets through and no others, and later filters stay above it. The ``assert_`` functions run a job of their own, at once, and are for readers
and small tables; they raise with a sample of the offending rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def _told(keys: Sequence[str]) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])


def passing(df: DataFrame, condition: Column, message: str, keys: Sequence[str]) -> DataFrame:
    """``df``; a row that fails ``condition`` (null counts as failing) stops the query, which names its ``keys``."""
    told = F.concat(F.lit(f"{message}: "), _told(keys))
    here = F.spark_partition_id() >= 0  # always true, and not deterministic in the optimiser's eyes
    return df.where(F.when(here & ~F.coalesce(condition, F.lit(False)), F.raise_error(told)).otherwise(F.lit(True)))


def alongside(df: DataFrame, told: DataFrame, condition: Column, message: str, keys: Sequence[str]) -> DataFrame:
    """``df``; a row of ``told``, another frame, that fails ``condition`` stops the query. For what rows alone can't tell, such as missing ones."""
    none = passing(told, condition, message, keys).where(F.spark_partition_id() < 0)  # read, and then left out
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df``; rows that repeat ``keys`` stop the query."""
    counted = df.withColumn("_times", F.count("*").over(Window.partitionBy(*keys)))
    return passing(counted, F.col("_times") == 1, f"{what} repeats keys {list(keys)}", keys).drop("_times")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The left join of both; a left row without a right one stops the query."""
    joined = left.join(right.withColumn("_found", F.lit(True)), list(keys), "left")
    return passing(joined, F.col("_found"), message, keys).drop("_found")


def assert_empty(df: DataFrame, message: str) -> None:
    sample = df.limit(10).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    assert_empty(df.groupBy(*keys).count().where("count > 1"), f"{what} repeats keys {list(keys)}")


def assert_all(df: DataFrame, condition: Column, message: str) -> None:
    """No row may fail ``condition``; null counts as failing."""
    assert_empty(df.where(~F.coalesce(condition, F.lit(False))), message)


def assert_matched(left: DataFrame, right: DataFrame, keys: Sequence[str], message: str) -> None:
    assert_empty(left.select(*keys).join(right.select(*keys), list(keys), "left_anti"), message)


def check_winsor(lower: float, upper: float, z_clip: float) -> None:
    if not 0 <= lower < upper <= 1:
        raise ValueError("winsor bounds must satisfy 0 <= lower < upper <= 1")
    if z_clip <= 0:
        raise ValueError("z_clip must be positive")


def valid_index_flags(df: DataFrame, flags: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``df``; flags other than 0 or 1, or more than one in a row, stop the query."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in flags]
    bad = F.lit(False)
    total = F.lit(0.0)
    for v in values:
        bad, total = bad | ~v.isin(0.0, 1.0), total + v
    return passing(df, ~(bad | (total > 1)), "index flags must be 0 or 1 and must not overlap", keys)


def one_hot_rows(df: DataFrame, columns: Sequence[str], what: str, keys: Sequence[str]) -> DataFrame:
    total = sum((F.col(f"`{c}`") for c in columns), F.lit(0))
    return passing(df, total == 1, f"{what} has rows that do not sum to 1", keys)


def consistent(df: DataFrame, pairs: Iterable[tuple[str, str]], keys: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """``df``; copies of a value must agree: both missing, or equal within absolute plus relative tolerance."""
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        same = (x.isNull() & y.isNull()) | (F.abs(x - y) <= tolerance + tolerance * F.abs(y))
        df = passing(df, same, f"columns {a} and {b} differ", keys)
    return df


def check_periods(periods: Sequence) -> None:
    """Labels are unique, starts do not come after ends, and periods do not overlap."""
    if not periods:
        raise ValueError("at least one period is needed")
    if len({p.label for p in periods}) < len(periods):
        raise ValueError("period labels repeat")
    ordered = sorted(periods, key=lambda p: p.start)
    for p in ordered:
        if p.start > p.end:
            raise ValueError(f"period {p.label} ends before it starts")
    for a, b in zip(ordered, ordered[1:], strict=False):
        if b.start <= a.end:
            raise ValueError(f"periods {a.label} and {b.label} overlap")


def check_signal_name(name: str) -> None:
    if not name or not all(c.isalnum() or c == "_" for c in name) or name.endswith(("_z", "_rank")):
        raise ValueError(f"invalid signal name {name!r}")
