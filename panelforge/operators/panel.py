"""Training panels: signals joined to context, features, labels, sample weights, folds, one-hots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import assert_empty, check_signal_name, check_winsor, matched, one_hot_rows, passing, require_columns, unique, valid_index_flags
from ..functions.keys import INDEX_FLAGS, UNKNOWN_BOARD, UNKNOWN_INDUSTRY, category, finite, index_bucket, parsed_date, stock_code
from .xsection import Feature, add_ranks_and_zs, add_robust_z, centered_rank, decile

KEYS = ("date", "stock_code")
LIQUIDITY = {"amount_k": "log1p_nonnegative", "turnover": "log1p_nonnegative", "logADV20": "identity", "logAmount20": "identity", "turnover20": "log1p_nonnegative"}


# ---- reshape

def wide_to_long(wide: DataFrame, key: str = "date", value: str = "value", name: str = "stock_code") -> DataFrame:
    """A matrix with one column per code to rows; missing cells go."""
    codes = [c for c in wide.columns if c != key]
    if not codes:
        raise ValueError("the matrix has no columns")
    df = wide.select(key, *[finite(F.col(f"`{c}`")).alias(c) for c in codes]).unpivot([key], codes, name, value)
    return df.where(F.col(value).isNotNull())


def long_to_wide(df: DataFrame, key: str = "date", name: str = "stock_code", value: str = "value", names: Sequence[str] | None = None) -> DataFrame:
    """Rows to a matrix; for export only, of as many columns as ``spark.sql.pivotMaxValues`` lets through: ``writers.write_matrix`` has no such limit. Passing ``names`` saves the pass that finds them."""
    return df.groupBy(key).pivot(name, list(names) if names else None).agg(F.first(value))


def looks_like_date(text: str) -> bool:
    digits = str(text).strip().split(" ")[0].replace("/", "-")
    for form in ("%Y-%m-%d", "%Y%m%d", "%Y-%m"):
        try:
            return 1990 <= dt.datetime.strptime(digits, form).year <= 2100
        except ValueError:
            continue
    return False


def date_like_ratio(values: Sequence[str]) -> float:
    return sum(map(looks_like_date, values)) / len(values) if values else 0.0


def date_like(label: Column) -> Column:
    """``looks_like_date`` of a column: yyyy-MM-dd, yyyyMMdd or yyyy-MM (or with slashes) of the years 1990 to 2100."""
    digits = F.regexp_replace(F.split(F.trim(label.cast("string")), " ")[0], "/", "-")
    day = F.coalesce(
        *[F.when(digits.rlike(f"^{shape}$"), F.try_to_timestamp(digits, F.lit(form))) for shape, form in (("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"), ("[0-9]{8}", "yyyyMMdd"), ("[0-9]{4}-[0-9]{1,2}", "yyyy-M"))]
    )
    return F.coalesce(F.year(day).between(1990, 2100), F.lit(False))


def signal_to_long(wide: DataFrame, value: str) -> DataFrame:
    """A signal matrix in either orientation to (date, stock_code, value); the more date-like axis, if at least half is, holds dates.

    All row labels count, which takes a pass over that column.
    """
    key, *codes = wide.columns
    rows = wide.agg(F.avg(date_like(F.col(f"`{key}`")).cast("int"))).first()[0] or 0.0
    columns = date_like_ratio(codes)
    if max(rows, columns) < 0.5 or rows == columns:
        raise ValueError("can't tell which axis of the matrix holds dates")
    other, at = ("stock_code", "date") if rows > columns else ("date", "stock_code")
    df = wide_to_long(wide, key, value, other).withColumnRenamed(key, at)
    out = df.select(parsed_date(F.col("date")).alias("date"), stock_code(F.col("stock_code")).alias("stock_code"), value)
    return unique(out, KEYS, f"signal {value}")


# ---- context and signals

def prepare_context(df: DataFrame, numeric: Sequence[str] = ("market_cap",), flags: Sequence[str] = tuple(INDEX_FLAGS)) -> DataFrame:
    """Normalised keys (rows without go), filled categories, coerced numbers; keys must be unique."""
    require_columns(df, [*KEYS, "industry", "board", *numeric, *flags], "context")
    out = df.withColumn("date", parsed_date(F.col("date"))).withColumn("stock_code", stock_code(F.col("stock_code")))
    out = out.where(F.col("date").isNotNull() & (F.col("stock_code") != ""))
    out = out.withColumn("industry", F.coalesce(category(F.col("industry")), F.lit(UNKNOWN_INDUSTRY))).withColumn("board", F.coalesce(category(F.col("board")), F.lit(UNKNOWN_BOARD)))
    out = out.withColumns({c: finite(F.col(c)) for c in (*numeric, *flags)})
    return unique(out, KEYS, "context")


def context_valid(flags: Sequence[str] = tuple(INDEX_FLAGS)) -> Column:
    ok = F.coalesce(F.col("market_cap") > 0, F.lit(False))
    return reduce(lambda a, c: a & F.col(c).isNotNull(), flags, ok)


def attach_signals(context: DataFrame, signals: Mapping[str, DataFrame]) -> DataFrame:
    """Left join of long signals (date, stock_code, value) as columns <name>_raw: all signals are pivoted once, so the context is joined once."""
    for name in signals:
        check_signal_name(name)
    stacked = reduce(DataFrame.unionByName, [s.select(*KEYS, F.lit(n).alias("_n"), finite(F.col("value")).alias("_v")) for n, s in signals.items()])
    # the counts of rows ride on the aggregation that pivots, so the check costs nothing more
    own = lambda n: F.col("_n") == n
    wide = stacked.groupBy(*KEYS).agg(*[F.first(F.when(own(n), F.col("_v")), True).alias(f"{n}_raw") for n in signals], F.greatest(*[F.count_if(own(n)) for n in signals], F.lit(0)).alias("_times"))
    wide = passing(wide, F.col("_times") <= 1, f"signals repeats keys {list(KEYS)}", KEYS)
    return context.join(wide.drop("_times"), list(KEYS), "left")


def signal_diagnostics(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows, missing rows and distinct dates of every raw signal."""
    long = frame.unpivot(list(KEYS), [f"{n}_raw" for n in names], "signal", "v")
    return long.groupBy("signal").agg(F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.countDistinct(F.when(F.col("v").isNotNull(), F.col("date"))).alias("dates"))


def add_features(
    frame: DataFrame,
    signals: Mapping[str, str],
    liquidity: Sequence[str] = (),
    lower: float = 0.01,
    upper: float = 0.99,
    z_clip: float = 5.0,
    unknown_index: str | None = "UNKNOWN_INDEX",
) -> DataFrame:
    """Size features, index bucket, and rank and z of each signal (name to transform) and liquidity column.

    The cross-section is all rows of the frame's date, so call this before labels are joined if the
    feature universe is meant to be wider than the labelled one.
    """
    check_winsor(lower, upper, z_clip)
    args = {"lower": lower, "upper": upper, "z_clip": z_clip}
    df = frame.withColumn("_cap", F.when(F.col("market_cap") > 0, F.col("market_cap")))
    df = df.withColumn("log_mcap", F.log("_cap")).withColumn("mcap_rank", centered_rank("_cap")).withColumn("size_decile", decile("_cap"))
    df = add_robust_z(df, "log_mcap", "log_mcap_z", **args).drop("_cap")
    if all(c in df.columns for c in INDEX_FLAGS):
        df = df.withColumn("index_bucket", index_bucket(unknown_index))
    return add_ranks_and_zs(df, model_inputs(signals, liquidity), **args)


def model_inputs(signals: Mapping[str, str], liquidity: Sequence[str] = ()) -> list[Feature]:
    return [*[Feature(c, c, LIQUIDITY[c], True) for c in liquidity], *[Feature(f"{n}_raw", n, t) for n, t in signals.items()]]


def eligible(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose required features are all there."""
    return frame.where(reduce(lambda a, c: a & F.col(c).isNotNull(), columns, F.col("size_decile") >= 0))


def inputs_present(features: Sequence[Feature]) -> Column:
    """Rows that will have all ranks and z-scores, told by their inputs, so that counting them needs no cross-section."""
    return reduce(lambda a, f: a & f.inside().isNotNull() & F.col(f.source).isNotNull(), features, F.coalesce(F.col("market_cap") > 0, F.lit(False)))


def labels(matrix_long: DataFrame, target: str, rank: str) -> DataFrame:
    """Finite labels with their centered rank per date."""
    df = matrix_long.select(*KEYS, finite(F.col("value")).alias(target)).where(F.col(target).isNotNull())
    return unique(df.withColumn(rank, centered_rank(target)), KEYS, "labels")  # dealt by date already


def sample_weights(panel: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Adds sample_weight = N / (D n_date): equal total weight for every date, mean 1.

    With ``universe`` the date counts, N and D are those of its rows on the panel's dates instead.
    """
    if universe is None:
        n, d = F.count("*").over(Window.partitionBy("date")), panel.agg(F.count("*").alias("_total"), F.countDistinct("date").alias("_dates"))
        return panel.crossJoin(F.broadcast(d)).withColumn("sample_weight", F.col("_total") / (F.col("_dates") * n)).drop("_total", "_dates")  # one row
    counts = matched(panel.select("date").distinct(), universe.groupBy("date").agg(F.count("*").alias("_n")), ["date"], "panel dates without a feature universe")
    total = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_dates"))
    per_date = counts.crossJoin(F.broadcast(total)).select("date", (F.col("_total") / (F.col("_dates") * F.col("_n"))).alias("sample_weight"))  # one row
    return panel.join(per_date, "date")


def _counted_weights(panel: DataFrame, n: str) -> DataFrame:
    """``sample_weights`` where column ``n`` holds the universe's rows of the date; the column goes."""
    total = panel.groupBy("date").agg(F.first(n).alias("_k")).agg(F.sum("_k").alias("_total"), F.count("*").alias("_dates"))
    return panel.crossJoin(F.broadcast(total)).withColumn("sample_weight", F.col("_total") / (F.col("_dates") * F.col(n))).drop("_total", "_dates", n)  # one row


def build_panel(
    context: DataFrame,
    label: DataFrame,
    signals: Mapping[str, DataFrame],
    transforms: Mapping[str, str],
    target: str = "y_raw_fwd",
    target_rank: str = "y_raw_rank_label",
    liquidity: Sequence[str] = (),
    universe_first: bool = True,
    winsor: tuple[float, float] = (0.01, 0.99),
    z_clip: float = 5.0,
) -> DataFrame:
    """The training panel: context, raw signals, ranks and z-scores, label and its rank, sample weight.

    ``universe_first`` takes cross-sections and weights from all rows of the context before labels are joined;
    otherwise from the labelled rows.
    """
    base = attach_signals(prepare_context(context, ("market_cap", *liquidity)), signals).where(context_valid())
    if not universe_first:
        base = base.join(label, list(KEYS))
    features = add_features(base, transforms, liquidity, *winsor, z_clip).where(inputs_present(model_inputs(transforms, liquidity)))
    if universe_first:
        features = features.withColumn("_universe", F.count("*").over(Window.partitionBy("date")))
        return _counted_weights(features.join(labels(label, target, target_rank), list(KEYS)), "_universe")
    panel = features.withColumn(target, finite(F.col("value"))).where(F.col(target).isNotNull()).withColumn(target_rank, centered_rank(target)).drop("value")
    return sample_weights(panel)


def label_distribution(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min and max per date of each label column."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return panel.groupBy("date").agg(F.count("*").alias("row_count"), *aggs)


def feature_diagnostics(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, missing, mean, median, std, min and max per date and feature."""
    long = panel.unpivot(["date"], list(columns), "feature", "v")
    return long.groupBy("date", "feature").agg(F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def feature_roles(signals: Sequence[str], liquidity: Sequence[str] = (), neutralized: Sequence[str] = (), target: str = "y_raw_fwd", target_rank: str = "y_raw_rank_label") -> dict[str, list[str]]:
    """Which columns of the panel are model inputs, keys, labels, or kept for tracing only."""
    own = [f"{n}{m}_{k}" for n in signals for m in (("_neutralized", "_rank_neutralized") if n in neutralized else ("",)) for k in ("rank", "z")]
    return {
        "signal_features": own,
        "categorical_context": ["industry", "board", "index_bucket", "size_decile"],
        "continuous_context": ["log_mcap_z", "mcap_rank", *[f"{c}_{k}" for c in liquidity for k in ("rank", "z")]],
        "traceability": [f"{n}_raw" for n in signals] + ["market_cap", "log_mcap"],
        "targets": [target, target_rank],
        "keys": list(KEYS),
        "weights": ["sample_weight"],
    }


# ---- folds

@dataclass(frozen=True)
class Fold:
    """Inclusive date ranges."""

    fold_id: int
    train: tuple[dt.date, dt.date]
    valid: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]

    def ranges(self) -> dict[str, tuple[dt.date, dt.date]]:
        return {"train": self.train, "valid": self.valid, "test": self.test}


def with_train_start(folds: Sequence[Fold], start: dt.date) -> tuple[Fold, ...]:
    return tuple(replace(f, train=(start, f.train[1])) for f in folds)


def _in_folds(dates: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    specs = F.array(*[F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(s).alias("split"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for f in folds for s, (a, b) in f.ranges().items()])
    hits = F.filter(specs, lambda r: F.col("date").between(r["lo"], r["hi"]))
    return dates.select("date").distinct().select("date", F.explode(hits).alias("r")).select("r.fold_id", "r.split", "date")


def embargo_dates(dates: DataFrame, folds: Sequence[Fold], embargo: int) -> DataFrame:
    """The last ``embargo`` available dates of every train and valid range."""
    df = _in_folds(dates, folds).where(F.col("split").isin("train", "valid"))
    from_end = F.row_number().over(Window.partitionBy("fold_id", "split").orderBy(F.desc("date")))
    return df.withColumn("_k", from_end).where(F.col("_k") <= embargo).drop("_k")


def fold_assignments(dates: DataFrame, folds: Sequence[Fold], embargo: int = 0) -> DataFrame:
    """(fold_id, split, date) without embargoed dates; a date may be in one split of a fold only."""
    df = unique(_in_folds(dates, folds), ["fold_id", "date"], "fold assignments")
    return df.join(embargo_dates(dates, folds, embargo), ["fold_id", "split", "date"], "left_anti") if embargo else df


def split_summary(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Dates, rows, most stocks on a date, and weight per fold and split."""
    per_date = panel.groupBy("date").agg(F.count("*").alias("rows"), F.countDistinct("stock_code").alias("stocks"), F.sum("sample_weight").alias("weight"))
    df = folds.join(per_date, "date", "left")
    return df.groupBy("fold_id", "split").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.countDistinct("date").alias("date_count"), F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.max("stocks").alias("max_stocks"), F.sum("weight").alias("weight_sum"))


def run_summary(panel: DataFrame, folds: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """What a build holds, by fold and split, by fold, and in all, from one scan: rows, dates, stocks, range of dates, weight, and missing ``features``.

    ``level`` is split, fold or all; the last covers every row of the panel once, in folds or not.
    """
    spans = folds.groupBy("date").agg(F.collect_list(F.struct("fold_id", "split")).alias("_in"))  # a fold holds a date once
    own = F.concat(F.array(F.struct(F.lit(None).cast(folds.schema["fold_id"].dataType).alias("fold_id"), F.lit(None).cast("string").alias("split"))), F.coalesce("_in", F.array().cast(spans.schema["_in"].dataType)))
    rows = panel.select("date", "stock_code", "sample_weight", *features).join(spans, "date", "left").select("*", F.explode(own).alias("_f")).select("*", "_f.*").drop("_f", "_in")
    missing = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing_{c}") for c in features]
    out = rows.groupingSets([["fold_id", "split"], ["fold_id"]], "fold_id", "split").agg(
        F.grouping("split").alias("_g"), F.count("*").alias("row_count"), F.countDistinct("date").alias("date_count"), F.countDistinct("stock_code").alias("stock_count"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.sum("sample_weight").alias("weight_sum"), *missing,
    )
    # the rows without a fold are the panel itself, once
    kept = out.where(F.col("fold_id").isNotNull() | (F.col("_g") == 0))
    return kept.select(F.when(F.col("fold_id").isNull(), "all").when(F.col("_g") == 1, "fold").otherwise("split").alias("level"), *[c for c in out.columns if c != "_g"])


def assert_fold_order(folds: DataFrame) -> None:
    """Every fold has all splits, and they follow one another in time."""
    edge = lambda f, s: f(F.when(F.col("split") == s, F.col("date")))
    g = folds.groupBy("fold_id").agg(edge(F.max, "train").alias("a"), edge(F.min, "valid").alias("b"), edge(F.max, "valid").alias("c"), edge(F.min, "test").alias("d"))
    assert_empty(g.where(~F.coalesce((F.col("a") < F.col("b")) & (F.col("c") < F.col("d")), F.lit(False))), "folds must have train before valid before test")


# ---- export tables

def index_constituents(frame: DataFrame) -> DataFrame:
    """(date, stock_code, index_name) for each flag that is 1."""
    long = frame.unpivot(list(KEYS), list(INDEX_FLAGS), "flag", "v").where("v = 1")
    names = F.create_map(*[F.lit(x) for kv in INDEX_FLAGS.items() for x in kv])
    return long.select(*KEYS, F.element_at(names, F.col("flag")).alias("index_name"))


def one_hot(frame: DataFrame, column: str, prefix: str, missing: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Keys and one 0/1 column per level, in the order of their names. Levels are read from the data unless given."""
    value = F.coalesce(category(F.col(column)), F.lit(missing))
    if levels is None:
        levels = [r[0] for r in frame.select(value.alias("v")).distinct().orderBy("v").collect()]  # one row per category
    names = [f"{prefix}__{x}" for x in levels]
    out = frame.select(*KEYS, *[(value == x).cast("tinyint").alias(n) for x, n in zip(levels, names, strict=True)])
    return one_hot_rows(out, names, column, KEYS)


def index_one_hot(frame: DataFrame, unknown: Sequence[str] = ()) -> DataFrame:
    """One-hot index membership with UNKNOWN_INDEX (any ``unknown`` column set) and NON_INDEX."""
    frame = valid_index_flags(frame, list(INDEX_FLAGS), KEYS)
    lost = reduce(lambda a, c: a | F.col(c).cast("boolean"), unknown, F.lit(False))
    member = {n: F.col(c).cast("int") == 1 for c, n in INDEX_FLAGS.items()}
    none = reduce(lambda a, b: a & ~b, member.values(), F.lit(True))
    columns = {f"index__{n}": c & ~lost for n, c in member.items()} | {"index__NON_INDEX": none & ~lost, "index__UNKNOWN_INDEX": lost}
    out = frame.select(*KEYS, *[c.cast("tinyint").alias(n) for n, c in columns.items()])
    return one_hot_rows(out, list(columns), "index membership", KEYS)


def restrict_to_universe(context: DataFrame, universe: DataFrame) -> DataFrame:
    """The context rows of the universe; repeated universe rows, or ones without context, stop the query."""
    return matched(unique(universe.select(*KEYS), KEYS, "universe"), context, KEYS, "universe rows without context").select(*context.columns)
