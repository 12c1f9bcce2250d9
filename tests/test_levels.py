"""Exact quantiles, statistics by level, discovered dimensions, and a training written as a run."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.functions.quantiles import exact_quantiles
from panelforge.operators import evaluate, model, panel, quality, training_run
from panelforge.sources import bundles

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]
QS = (0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_equal_those_of_numpy(spark, parts):
    rng = random.Random(parts)
    values = {"ties": [float(rng.choice([0, 0, 0, 1, 2])) for _ in range(500)], "wide": [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(333)], "one": [7.5], "two": [-1.0, 3.0], "none": [None] * 3, "zeros": [0.0, -0.0, 0.0, 5.0]}
    rows = [(s, v) for s, vs in values.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, v double").repartition(parts)
    got = {r.s: r for r in exact_quantiles(df, "s", "v", QS).collect()}
    assert set(got) == set(values) - {"none"}
    for s, r in got.items():
        np.testing.assert_allclose([*r][1:], np.quantile(values[s], QS), rtol=1e-12)
    assert exact_quantiles(df.limit(0), "s", "v", QS).collect() == []


def test_no_task_holds_all_values(spark):
    df = spark.range(20_000).select(F.lit("a").alias("s"), (F.col("id") % 7919).cast("double").alias("v"))
    plan = exact_quantiles(df, "s", "v", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "SinglePartition" not in plan


def test_levels_come_from_one_scan(spark, tmp_path):
    rows = [(d, f"{k:06d}", 0.1 * k - 0.3 if k % 4 else None, float(i)) for i, d in enumerate(D) for k in range(8)]
    spark.createDataFrame(rows, "date date, stock_code string, a double, b double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = quality.level_stats(df, ["a", "b"])
    pdf, got = df.toPandas(), {(r.level, r.date, r.stock_code): r for r in out.collect()}
    assert len(got) == 12 + 8 + 1
    for key, group in [(("all", None, None), pdf), *((("date", d, None), g) for d, g in pdf.groupby("date")), *((("stock", None, c), g) for c, g in pdf.groupby("stock_code"))]:
        r, a = got[key], group["a"].dropna()
        assert (r.a_count, r.b_count) == (len(a), len(group)) and r.a_abs_gt_20pct == int((a.abs() > 0.2).sum())
        assert (pd.isna(r.a_mean) and a.empty) or (r.a_mean == pytest.approx(a.mean()) and r.a_std == pytest.approx(a.std(ddof=0)))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_run_summaries_count_every_row_once(spark):
    rows = [(d, f"{k:06d}", 1.0 + k % 2, None if k == 0 else 1.0) for d in D for k in range(4)]
    p = spark.createDataFrame(rows, "date date, stock_code string, sample_weight double, x double")
    folds = panel.fold_assignments(p.select("date"), [panel.Fold(1, (D[0], D[3]), (D[4], D[5]), (D[6], D[7])), panel.Fold(2, (D[0], D[5]), (D[6], D[7]), (D[8], D[9]))])
    got = {(r.level, r.fold_id, r.split): r for r in panel.run_summary(p, folds, ["x"]).collect()}
    assert {k: r.row_count for k, r in got.items()} == {
        ("all", None, None): 48, ("fold", 1, None): 32, ("fold", 2, None): 40,
        ("split", 1, "train"): 16, ("split", 1, "valid"): 8, ("split", 1, "test"): 8, ("split", 2, "train"): 24, ("split", 2, "valid"): 8, ("split", 2, "test"): 8,
    }
    whole = got["all", None, None]
    assert (whole.date_count, whole.stock_count, whole.start_date, whole.end_date, whole.weight_sum, whole.missing_x) == (12, 4, D[0], D[11], 72.0, 12)


def frames(spark):
    rows = [(d, f"{k:06d}", "ab"[k % 2], None if k else "main", float(k), None, 0.1 * k - 0.2, 0.1 * k) for d in D[:4] for k in range(6)]
    p = spark.createDataFrame(rows, "date date, stock_code string, industry string, board string, log_mcap double, turnover20 double, y_resid_fwd double, sample_weight double")
    pred = p.select(F.lit(1).alias("fold_id"), F.lit("test").alias("split"), "date", "stock_code", F.col("log_mcap").alias("s"), "y_resid_fwd", "sample_weight")
    return p, pred


def test_dimensions_are_those_with_values(spark):
    p, pred = frames(spark)
    d = evaluate.discovered(pred, p, "y_resid_fwd")
    assert d.context == ("industry", "board", "log_mcap", "turnover20")
    assert d.conditions == {"mcap_tercile": "log_mcap", "turnover_tercile": "turnover20"}
    assert d.groups == ("industry", "board", "mcap_tercile") and d.checked == ("y_resid_fwd", "sample_weight")
    # the first source that is there makes the condition
    ranked = evaluate.discovered(pred.drop("sample_weight"), p.withColumn("mcap_rank", F.lit(0.5)).withColumn("industry", F.lit(None).cast("string")), "y_resid_fwd", "other")
    assert ranked.conditions["mcap_tercile"] == "mcap_rank" and "industry" not in ranked.groups and ranked.checked == ("y_resid_fwd",)
    bare = evaluate.discovered(pred, p.select("date", "stock_code"), "y_resid_fwd")
    assert bare == evaluate.Dimensions((), {}, (), ())


def test_evaluation_by_discovered_dimensions(spark):
    p, pred = frames(spark)
    out = evaluate.evaluate_discovered(pred, p, ["s"], "y_resid_fwd")
    groups = {(r.dimension, r.group) for r in out["group_ic"].select("dimension", "group").distinct().collect()}
    assert groups == {("industry", "a"), ("industry", "b"), ("mcap_tercile", "low"), ("mcap_tercile", "mid"), ("mcap_tercile", "high")}
    assert all(r.mean_ic == pytest.approx(1.0) for r in out["ic_summary"].collect())
    bare = evaluate.evaluate_discovered(pred, p.select("date", "stock_code"), ["s"], "y_resid_fwd")
    assert "group_ic" not in bare and bare["daily_ic"].count() == 4
    with pytest.raises(PySparkException, match="differ"):
        evaluate.evaluate_discovered(pred.withColumn("sample_weight", F.lit(9.0)), p, ["s"], "y_resid_fwd")["daily_ic"].collect()
    metrics = evaluate.prediction_metrics(pred, ["s"], "y_resid_fwd").first()
    assert (metrics.date_count, metrics.mean_ic, metrics.std_ic, metrics.mean_rankic) == (4, pytest.approx(1.0), pytest.approx(0.0), pytest.approx(1.0))


# ---- runs


def test_metadata_come_from_the_data_before_what_is_given():
    real = {"metadata": {"alpha_is_real": True, "model_form": "p"}}
    assert training_run.run_metadata(real, {"alpha_is_real": False})["training_role"] == "direct_and_marginal_signal_probe"
    assert training_run.run_metadata({"metadata": "none"}, {"alpha_is_real": False, "training_role": "mine"})["training_role"] == "mine"
    plain = training_run.run_metadata()
    assert plain["alpha_is_real"] is False and plain["signal_feature_role"] == "signal_features" and plain["context_only_policy"] == training_run.POLICY
    assert "placeholder" in training_run.run_notes(plain, "y")[-1] and "placeholder" not in training_run.run_notes({"alpha_is_real": True}, "y")[-1]


def test_a_training_is_written_as_a_run(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(d, f"{k:06d}", float(s := rng.normal()), "ab"[k % 2], 0.5 * s, 1.0) for d in D for k in range(30)]
    p = spark.createDataFrame(rows, "date date, stock_code string, sig double, industry string, y_fwd double, sample_weight double")
    roles = {"signal_features": ["sig"], "categorical_context": ["industry"], "continuous_context": [], "targets": ["y_fwd"], "keys": ["date", "stock_code"], "weights": ["sample_weight"]}
    c = model.contract(roles, "y_fwd", {"sig": 1})
    folds = panel.fold_assignments(p.select("date"), [panel.Fold(1, (D[0], D[5]), (D[6], D[7]), (D[8], D[11]))])
    out = model.train_folds(p, folds, c, "y_fwd", params={"n_estimators": 3, "min_child_samples": 10})
    root = str(tmp_path / "run")
    told = training_run.write_run(spark, out, c, "y_fwd", root, training_run.run_metadata(), ["other"], "explicit_feature_monotone_constraints")
    s = told["summary"]
    assert s["fold_count"] == 1 and s["folds"][0]["rows"] == {"train": 180, "valid": 60, "test": 120} and s["folds"][0]["date_ranges"]["test"]["date_count"] == 4
    assert s["monotone_constraints"]["constrained_features"] == ["sig"] and s["feature_exclusion"] == ["other"]
    assert s["folds"][0]["best_iteration"] == out["models"][1].best_iteration and s["model_diagnostics"]["tree_count"] == len(out["models"][1].trees)
    assert told["tables"]["predictions"]["rows"] == 180 and bundles.verify_bundle(spark, root) == []
    metrics = bundles.read_bundle(spark, root)["metrics_by_fold_split"]
    assert {(r.split, r.score_col) for r in metrics.collect()} == {(x, y) for x in ("valid", "test") for y in training_run.SCORES}
    models, again = training_run.read_run_models(spark, root)
    assert again == c and models[1].told() == out["models"][1].told()
