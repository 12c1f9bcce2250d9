"""Index membership: as-of snapshots, and point-in-time membership with explicit unknowns; dataset assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import alongside, matched, passing, unique
from ..functions.keys import BOARDS, MAIN_BOARDS, board_segment, finite

KEYS = ["date", "stock_code"]


@dataclass(frozen=True)
class IndexSpec:
    """A flag column, the index's name, and how many members are plausible."""

    column: str
    name: str
    least: int
    most: int


# The four indexes.
INDEXES = (
    IndexSpec("is_csi300", "CSI300", 297, 303),
    IndexSpec("is_csi500", "CSI500", 495, 505),
    IndexSpec("is_csi1000", "CSI1000", 990, 1010),
    IndexSpec("is_csi2000", "CSI2000", 1980, 2020),
)


def asof_membership(rows: DataFrame, snapshots: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: 1 if the stock is in the latest snapshot (snapshot_date, stock_code) not after the date; 0 before the first.

    Snapshot dates become intervals, which are joined to the distinct dates of the rows; the rows themselves
    are joined by equality only.
    """
    days = snapshots.select("snapshot_date").distinct()
    dates = rows.select("date").distinct()
    # both sides hold days, so one window over their union finds the latest snapshot of each
    both = dates.select(F.col("date").alias("d"), F.lit(None).cast("date").alias("s")).unionByName(days.select(F.col("snapshot_date").alias("d"), F.col("snapshot_date").alias("s")))
    latest = both.withColumn("snapshot_date", F.last("s", ignorenulls=True).over(Window.orderBy("d"))).where("s is null").select(F.col("d").alias("date"), "snapshot_date")
    members = snapshots.select("snapshot_date", "stock_code", F.lit(1).alias("_m")).distinct()
    df = rows.join(latest, "date", "left").join(members, ["snapshot_date", "stock_code"], "left")
    return df.withColumn(flag, F.coalesce("_m", F.lit(0))).drop("_m", "snapshot_date")


def membership_quality(dates: DataFrame, manifest: DataFrame, members: DataFrame, indexes: Sequence[IndexSpec] = INDEXES, tolerance: float = 0.01) -> DataFrame:
    """One row per date and index: counts, weight sum, whether it is reliable, and why not.

    ``manifest`` is (index_name, date, quality_status), ``members`` (index_name, date, stock_code, weight, quality_status).
    """
    specs = F.array(*[F.struct(F.lit(i.column).alias("flag"), F.lit(i.name).alias("index_name"), F.lit(i.least).alias("least"), F.lit(i.most).alias("most")) for i in indexes])
    frame = dates.select("date").distinct().select("date", F.inline(specs))
    code = F.when(F.col("stock_code") != "", F.col("stock_code"))
    found = members.groupBy("index_name", "date").agg(
        F.countDistinct(code).alias("member_count"),
        (F.count(code) - F.countDistinct(code)).alias("duplicate_rows"),
        F.sum(finite(F.col("weight"))).alias("weight_sum"),
        F.sort_array(F.collect_set(F.trim("quality_status"))).alias("statuses"),
    )
    source = unique(manifest.select("index_name", "date", F.coalesce("quality_status", F.lit("")).alias("source_status")), ["index_name", "date"], "manifest")
    df = frame.join(source, ["index_name", "date"], "left").join(found, ["index_name", "date"], "left")
    status = F.col("source_status")
    off = F.abs(F.col("weight_sum") / 100 - 1)
    reasons = F.when(status.isNull(), "missing_asof_row").when(F.col("member_count").isNull(), "missing_partition").otherwise(
        F.concat_ws(
            ";",
            F.when(status != "complete", F.concat(F.lit("source_quality_status="), F.when(status == "", "<missing>").otherwise(status))),
            F.when(~((F.size("statuses") == 1) & F.array_contains("statuses", "complete")), F.concat(F.lit("partition_quality_status="), F.array_join("statuses", ","))),
            F.when(F.col("duplicate_rows") != 0, F.format_string("duplicate_member_rows=%d", "duplicate_rows")),
            F.when(~F.col("member_count").between(F.col("least"), F.col("most")), F.format_string("observed_member_count=%d", "member_count")),
            F.when(F.coalesce(off > tolerance, F.lit(True)), "weight_sum"),
        )
    )
    return df.withColumn("unreliable_reasons", reasons).withColumn("reliable", F.col("unreliable_reasons") == "").drop("statuses")


def membership_panel(universe: DataFrame, quality: DataFrame, members: DataFrame, indexes: Sequence[IndexSpec] = INDEXES) -> DataFrame:
    """Per (date, stock_code): a flag and an unknown mark for each index. A date without reliable members is unknown for all stocks."""
    by_date = quality.groupBy("date").pivot("flag", [i.column for i in indexes]).agg(F.first("reliable"))
    known = by_date.select("date", *[F.coalesce(F.col(i.column), F.lit(False)).alias(f"_{i.column}") for i in indexes])
    names = F.create_map(*[F.lit(x) for i in indexes for x in (i.name, i.column)])
    held = members.where(F.col("stock_code") != "").select("date", "stock_code", F.try_element_at(names, F.col("index_name")).alias("flag")).distinct()
    wide = held.groupBy(*KEYS).pivot("flag", [i.column for i in indexes]).agg(F.lit(True))
    df = unique(universe.select(*KEYS), KEYS, "universe").join(known, "date", "left").join(wide, KEYS, "left")
    reliable = {i.column: F.coalesce(F.col(f"_{i.column}"), F.lit(False)) for i in indexes}
    flags = [(r & F.coalesce(F.col(c), F.lit(False))).alias(c) for c, r in reliable.items()]
    unknown = {c: ~r for c, r in reliable.items()}
    any_unknown = reduce(lambda a, b: a | b, unknown.values())
    out = df.select(*KEYS, *flags, *[u.alias(f"{c}_unknown") for c, u in unknown.items()], any_unknown.alias("index_membership_any_unknown"), (~any_unknown).alias("index_membership_all_known"), F.lit(True).alias("historical_pit_index_membership"))
    total = reduce(lambda a, b: a + b, [F.col(i.column).cast("int") for i in indexes])
    return passing(out, total <= 1, "reliable index memberships overlap", KEYS)


def membership_summary(quality: DataFrame) -> DataFrame:
    return quality.groupBy("flag").agg(F.count_if("reliable").alias("reliable_dates"), F.count_if(~F.col("reliable")).alias("unreliable_dates"), F.min("member_count").alias("fewest_members"), F.max("member_count").alias("most_members"))


def board_dimension(board: DataFrame) -> DataFrame:
    """Listing boards with their segment and a flag for each; unknown segments are an error."""
    df = board.withColumn("listing_board_segment", board_segment(F.col("listing_board_code"), F.col("exchange_code")))
    df = passing(df, F.coalesce(F.col("listing_board_segment") != "", F.lit(True)), "listing boards without a segment", ["stock_code"])
    seg = F.col("listing_board_segment")
    return df.withColumns({f"is_{s.lower()}": seg == s for s in BOARDS}).withColumn("is_main_board", seg.isin(*MAIN_BOARDS))


def daily_dataset(daily: DataFrame, industry: DataFrame, board: DataFrame, membership: DataFrame, required: Mapping[str, bool] | None = None) -> DataFrame:
    """Daily metrics with industry and board of the stock and membership of the day; what is ``required`` must match.

    Keys that repeat in any input, metrics that are infinite or NaN, membership flags that contradict each other and an empty
    result stop the query.
    """
    need = {"industry": True, "board": True, "membership": True} | dict(required or {})
    parts = {"industry": (industry, ["stock_code"]), "board": (board_dimension(board), ["stock_code"]), "membership": (membership, KEYS)}
    df = unique(daily, KEYS, "daily metrics")
    for name, (part, keys) in parts.items():
        part = unique(part, keys, name)
        df = matched(df, part, keys, f"daily rows without {name}") if need[name] else df.join(part, keys, "left")
    return valid_dataset(df, [c for c, t in daily.dtypes if t in ("float", "double")])


def valid_dataset(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``df``; what ``daily_dataset`` must not hold stops the query."""
    for c in metrics:
        x = F.col(f"`{c}`")
        df = passing(df, x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf"))), f"{c} must be finite or null", KEYS)
    if {"index_membership_any_unknown", "index_membership_all_known"} <= set(df.columns):
        unknown, known = F.col("index_membership_any_unknown"), F.col("index_membership_all_known")
        df = passing(df, unknown.isNull() | known.isNull() | (unknown != known), "membership flags contradict each other", KEYS)
    rows = df.select(F.lit(1).alias("_one")).limit(1).agg(F.count("*").alias("rows"))
    return alongside(df, rows, F.col("rows") > 0, "the dataset is empty", ["rows"])


def date_counts(df: DataFrame, nullable: Sequence[str]) -> DataFrame:
    """Index of a dated dataset: rows, stocks and missing values per date."""
    return df.groupBy("date").agg(F.count("*").alias("row_count"), F.countDistinct("stock_code").alias("stock_count"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in nullable])


def latest_category_counts(df: DataFrame, category: str) -> DataFrame:
    last = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(last), "date").groupBy(category).agg(F.count("*").alias("row_count"))  # one row


def singleton_categories(df: DataFrame, category: str) -> DataFrame:
    """Categories with exactly one member on a date."""
    return df.groupBy("date", category).agg(F.count("*").alias("n"), F.first("stock_code").alias("stock_code")).where("n = 1").drop("n")
