"""A training as one unit: metadata and where it comes from, what was trained, and its bundle of tables and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources import bundles
from . import evaluate, model
from .model import Contract

SCORES = ("pred_direct", "score_marginal", "score_marginal_z")
#: Metadata of a run that has none of its own, and the role of a run by whether its signal is real.
PLACEHOLDER = {
    "signal_stage": "placeholder_alpha_probe",
    "alpha_source": "placeholder_liquidity",
    "alpha_is_real": False,
    "production_eligible": False,
    "model_form": "p = g(alpha_placeholder, c)",
    "training_role": "direct_and_marginal_placeholder_probe",
}
ROLES = {True: "direct_and_marginal_signal_probe", False: "direct_and_marginal_placeholder_probe"}
POLICY = "zero_signal_features_at_centered_neutral"


def run_metadata(data_summary: Mapping[str, Any] | None = None, given: Mapping[str, Any] | None = None, signal_role: str = "signal_features") -> dict[str, Any]:
    """Metadata of a training: that in the summary of its data if it holds any, else what is ``given``, else that of a placeholder.

    The role follows from whether the signal is real, unless the metadata name one; the role of the signals and the
    policy of context-only predictions are those of this run in any case.
    """
    own = (data_summary or {}).get("metadata")
    chosen = own if isinstance(own, Mapping) else given
    told = dict(PLACEHOLDER) if chosen is None else {str(k): v for k, v in chosen.items()}
    told.setdefault("training_role", ROLES[told.get("alpha_is_real") is True])
    return told | {"signal_feature_role": signal_role, "context_only_policy": POLICY}


def run_notes(metadata: Mapping[str, Any], target: str) -> list[str]:
    """What a reader of the run has to know."""
    about = "Context-only predictions set signals to 0, their centred neutral value, and keep the context." if metadata.get("alpha_is_real") is True else "The signal is a placeholder made of liquidity; this is no production model."
    return ["Folds are fitted on their train dates; valid dates only stop the boosting, test dates are only predicted.", "score_marginal is pred_direct less pred_context_only.", f"Metrics hold scores against {target}.", about]


def run_summary(out: Mapping[str, Any], c: Contract, target: str, metadata: Mapping[str, Any], excluded: Sequence[str] = (), policy: str = "none") -> dict[str, Any]:
    """The summary of what ``model.train_folds`` returned; its parts are of a size that folds and features bound."""
    trees = {f: model.tree_diagnostics(m) for f, m in out["models"].items() if hasattr(m, "trees")}
    folds: dict[int, dict[str, Any]] = {}
    for r in out["folds"].orderBy("fold_id", "start_date").collect():  # a row for each fold and split
        own = folds.setdefault(r["fold_id"], {"fold_id": r["fold_id"], "best_iteration": r["best_iteration"], "rows": {}, "date_ranges": {}, "tree_diagnostics": trees.get(r["fold_id"])})
        own["rows"][r["split"]] = r["row_count"]
        own["date_ranges"][r["split"]] = {"start": str(r["start_date"]), "end": str(r["end_date"]), "date_count": r["date_count"]}
    return {
        "metadata": dict(metadata),
        "fold_count": len(folds),
        "target_col": target,
        "feature_columns": list(c.features),
        "signal_features": list(c.signals),
        "categorical_features": list(c.categories),
        "continuous_features": list(c.numbers),
        "context_only_zeroed_features": list(c.signals),
        "feature_exclusion": sorted(excluded),
        "score_columns": ["pred_direct", "pred_context_only", "score_marginal", "score_marginal_z"],
        "monotone_constraints": model.constraint_summary(c, policy),
        "folds": list(folds.values()),
        "model_diagnostics": model.summarize_tree_diagnostics(trees) if trees else {"available": False},
        "notes": run_notes(metadata, target),
    }


def write_run(spark: SparkSession, out: Mapping[str, Any], c: Contract, target: str, root: str, metadata: Mapping[str, Any], excluded: Sequence[str] = (), policy: str = "none", version: str | None = None) -> dict[str, Any]:
    """The run as a bundle of kind training_run with its models beside it; returns the manifest.

    Models are written first: a version that readers see has them.
    """
    predictions: DataFrame = out["predictions"]
    tables = {"predictions": predictions, "feature_gain": out["importance"], "folds": out["folds"], "metrics_by_fold_split": evaluate.prediction_metrics(predictions, SCORES, "y_true")}
    summary = run_summary(out, c, target, metadata, excluded, policy)
    name = version or bundles.new_version()
    model.save_models(spark, out["models"], c, f"{root.rstrip('/')}/models/{name}")
    return bundles.write_bundle(spark, "training_run", tables, root, summary, name)


def read_run_models(spark: SparkSession, root: str) -> tuple[dict[int, Any], Contract]:
    """Models of the current version of a run."""
    return model.load_models(spark, f"{root.rstrip('/')}/models/{bundles.read_manifest(spark, root)['version']}")
