"""Bundles: several tables of one run with a manifest, visible all at once or not at all.

A bundle's kind declares its tables and their keys as data. ``write_bundle`` writes each table into the folder of a version, in key
order, reads it back for its digest and leaves a note beside it; then the manifest; and last it replaces the file ``CURRENT``, which names
the version that readers see. A job that is lost on the way leaves the old version as it is, and the same version written again takes
up what has a note already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import require_columns
from ..functions.storage import forget, stored
from .writers import folded, table_digest, write_sorted

STOCK_DAY, DAY, SERIES = ("date", "stock_code"), ("fold_id", "split", "date"), ("fold_id", "split", "bucket_index")
_TRAINING = {"panel": STOCK_DAY, "fold_assignments": ("fold_id", "date"), "label_distribution": ("date",), "feature_diagnostics": ("feature", "date"), "split_summary": ("fold_id", "split")}
#: Tables of each kind, named as the operators name them, and the keys in whose order they are written.
KINDS: dict[str, dict[str, tuple[str, ...]]] = {
    "raw_features": {"raw_training_features": STOCK_DAY, "index_constituents": (*STOCK_DAY, "index_name"), "industry_one_hot": STOCK_DAY, "board_one_hot": STOCK_DAY, "index_one_hot": STOCK_DAY},
    "placeholder_training": _TRAINING,
    "alpha_training": _TRAINING | {"signal_diagnostics": ("signal",), "neutralization_diagnostics": ("signal_name", "input_kind", "date")},
    "non_neutralized_training": _TRAINING | {"signal_diagnostics": ("signal",)},
    "training_run": {"predictions": (*DAY, "stock_code"), "feature_gain": ("fold_id", "feature"), "folds": ("fold_id", "split"), "metrics_by_fold_split": ("fold_id", "split", "score_col")},
    "model_evaluation": {
        "frame": (*DAY, "stock_code"),
        "daily_ic": (*DAY, "score_col"),
        "ic_summary": ("fold_id", "split", "score_col"),
        "spread_by_date": (*DAY, "score_col"),
        "spread_summary": ("fold_id", "split", "score_col"),
        "group_ic": (*DAY, "score_col", "dimension", "group"),
        "group_ic_summary": ("fold_id", "split", "score_col", "dimension", "group"),
        "feature_gain_by_fold": ("fold_id", "feature"),
        "feature_gain_summary": ("feature",),
        "feature_gain_roles": ("role",),
    },
    "rank_bucket_nav": {
        "daily_returns": (*SERIES, "date"),
        "nav": (*SERIES, "date"),
        "summary": SERIES,
        "constituents": (*SERIES, "date", "stock_code"),
        "industry_daily": (*SERIES, "date", "industry"),
        "industry_summary": (*SERIES, "industry"),
        "size_daily": (*SERIES, "date", "metric"),
        "size_summary": (*SERIES, "metric"),
        "size_decile_daily": (*SERIES, "date", "size_decile"),
    },
    "rank_bucket_periods": {"period_nav": ("period", "bucket_index", "date"), "period_summary": ("period", "bucket_index"), "requested_metrics": ("period", "bucket"), "period_industries": ("period", "bucket_index", "industry"), "industry_preferences": ("period", "bucket_index", "side", "side_rank")},
    "signal_comparison": {"comparison": ("signal_id", "period", "bucket_index"), "industry_preferences": ("signal_id", "period", "bucket_index", "side", "side_rank")},
    "rank_alignment": {"daily_alignment": ("candidate", *DAY), "period_alignment": ("candidate", "period")},
    "neutralization_analysis": {"distributions": ("level", "date", "stock_code"), "daily": ("date",), "symbol_examples": ("stock_code",), "diagnostics_summary": ("column",)},
    "pit_membership": {"panel": STOCK_DAY, "quality": ("flag", "date"), "summary": ("flag",), "index": ("date",)},
    "daily_dataset": {"panel": STOCK_DAY, "index": ("date",)},
}


class _Files:
    """Small files below a folder, on whatever file system Spark knows for it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hadoop = spark, root.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def read(self, name: str) -> Any:
        """The JSON in a file, or None if there is none."""
        path = self._path(name)
        system = path.getFileSystem(self.conf)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> None:
        """Replaces a file in one step: readers see the old content or the new one."""
        own = f"{name}.{uuid.uuid4().hex}"
        path = self._path(own)
        stream = path.getFileSystem(self.conf).create(path, True)
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str).encode()))
        finally:
            stream.close()
        rename = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        rename[0] = self.hadoop.Options.Rename.OVERWRITE
        self.hadoop.FileContext.getFileContext(path.toUri(), self.conf).rename(path, self._path(name), rename)


def check_tables(kind: str, tables: Mapping[str, DataFrame]) -> dict[str, tuple[str, ...]]:
    """The declared keys of ``tables``; a table that the kind doesn't have, or without its keys, is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of bundle {kind!r}: {sorted(KINDS)}")
    unknown = sorted(set(tables) - set(KINDS[kind]))
    if unknown or not tables:
        raise ValueError(f"a {kind} bundle has no tables {unknown}" if unknown else "a bundle needs a table")
    for name, df in tables.items():
        require_columns(df, KINDS[kind][name], name)
    return {name: KINDS[kind][name] for name in tables}


def new_version() -> str:
    return uuid.uuid4().hex


def write_bundle(spark: SparkSession, kind: str, tables: Mapping[str, DataFrame], root: str, summary: Mapping[str, Any] | None = None, version: str | None = None, formats: Sequence[str] = ("parquet",)) -> dict[str, Any]:
    """Write ``tables`` as a version of the bundle at ``root`` and make it the current one; returns the manifest.

    Every table is written in each of ``formats`` (parquet, orc, json or csv). Give a run's own ``version`` to take up its lost write: tables
    that have a note with the same columns are not written again. Digests come from the written rows, on executors; they do not depend on
    order or partitions, and ``digest`` folds them into one of the package. Old versions stay until ``drop_versions``.
    """
    keys, files = check_tables(kind, tables), _Files(spark, root)
    version = version or new_version()
    at = f"versions/{version}"
    told = {}
    for name, df in tables.items():
        done = files.read(f"{at}/{name}.json")
        if done and done["columns"] == df.columns and done["formats"] == list(formats):
            told[name] = done
            continue
        for form in formats:
            write_sorted(df, f"{root.rstrip('/')}/{at}/{name}.{form}", keys[name], form, options={"header": "true", "dateFormat": "yyyy-MM-dd"} if form == "csv" else {})
        found = table_digest(spark.read.schema(df.schema).format(formats[0]).options(header="true").load(f"{root.rstrip('/')}/{at}/{name}.{formats[0]}")).first()
        told[name] = {"rows": found["rows"], "digest": found["digest"], "columns": df.columns, "keys": list(keys[name]), "formats": list(formats)}
        files.write(f"{at}/{name}.json", told[name])
    manifest = {"kind": kind, "version": version, "tables": told, "digest": folded({n: t["digest"] for n, t in told.items()}), "summary": dict(summary or {})}
    files.write(f"{at}/manifest.json", manifest)
    files.write("CURRENT", {"version": version})
    return manifest


def read_manifest(spark: SparkSession, root: str, version: str | None = None) -> dict[str, Any]:
    """The manifest of a version, or of the current one."""
    files = _Files(spark, root)
    if version is None:
        current = files.read("CURRENT")
        if current is None:
            raise FileNotFoundError(f"no bundle is finished at {root}")
        version = current["version"]
    manifest = files.read(f"versions/{version}/manifest.json")
    if manifest is None:
        raise FileNotFoundError(f"version {version} of the bundle at {root} is not finished")
    return manifest


def read_bundle(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """Tables by name, of the current version unless another one is given."""
    manifest = read_manifest(spark, root, version)
    place = lambda name, form: f"{root.rstrip('/')}/versions/{manifest['version']}/{name}.{form}"
    return {n: spark.read.format(t["formats"][0]).options(header="true").load(place(n, t["formats"][0])) for n, t in manifest["tables"].items()}


def verify_bundle(spark: SparkSession, root: str) -> list[str]:
    """Names of tables of the current version whose rows are not those of the manifest."""
    manifest = read_manifest(spark, root)
    return sorted(n for n, df in read_bundle(spark, root).items() if table_digest(df).first()["digest"] != manifest["tables"][n]["digest"])


def drop_versions(spark: SparkSession, root: str) -> list[str]:
    """Delete all versions but the current one: call it when no reader is left on them."""
    current, files = read_manifest(spark, root)["version"], _Files(spark, root)
    path = files._path("versions")
    system = path.getFileSystem(files.conf)
    old = sorted(s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName() != current)
    for name in old:
        system.delete(files._path(f"versions/{name}"), True)
    return old


def raw_feature_summary(features: DataFrame, constituents: DataFrame) -> DataFrame:
    """One row of a raw feature export: rows, dates, stocks, their range, and rows of index constituents."""
    own = features.agg(F.count("*").alias("row_count"), F.countDistinct("date").alias("date_count"), F.countDistinct("stock_code").alias("stock_count"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    return own.crossJoin(constituents.agg(F.count("*").alias("index_constituent_row_count")))  # one row each


def export_raw_features(spark: SparkSession, context: DataFrame, signals: Mapping[str, DataFrame], root: str, universe: DataFrame | None = None, notes: Sequence[str] = (), version: str | None = None) -> dict[str, Any]:
    """Raw inputs of a training, without any transform: context and raw signals of the universe's rows, index constituents and the one-hot matrices."""
    from ..operators import diagnose, panel

    base = panel.restrict_to_universe(context, universe) if universe is not None else context
    # five tables in two formats and their summaries come from it, each with passes of its own
    features, own = stored(panel.attach_signals(base, signals) if signals else base, "raw-features")
    tables = {
        "raw_training_features": features,
        "index_constituents": panel.index_constituents(features),
        "industry_one_hot": panel.one_hot(features, "industry", "industry", "UNKNOWN_INDUSTRY"),
        "board_one_hot": panel.one_hot(features, "board", "board", "UNKNOWN_BOARD"),
        "index_one_hot": panel.index_one_hot(features, [c for c in features.columns if c.endswith("_unknown")]),
    }
    summary = raw_feature_summary(features, tables["index_constituents"]).first().asDict()
    summary["one_hots"] = {n: [r.asDict() for r in diagnose.one_hot_summary(tables[n]).orderBy("column").collect()] for n in ("industry_one_hot", "board_one_hot", "index_one_hot")}  # a row for each category
    summary["signals"] = [r.asDict() for r in panel.signal_diagnostics(features, list(signals)).orderBy("signal").collect()] if signals else []
    summary["universe"] = "none" if universe is None else "given"
    summary["notes"] = list(notes)
    manifest = write_bundle(spark, "raw_features", tables, root, summary, version, ("parquet", "csv"))
    forget(spark, own)
    return manifest
