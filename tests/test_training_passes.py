"""What a training shuffles in each of its passes, and what it leaves on disk."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.functions import storage
from panelforge.operators import model, panel


class Seen(Exception):
    pass


def inputs(spark):
    days = [dt.date(2024, 1, k) for k in range(1, 7)]
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    rows = dates.crossJoin(spark.range(30)).select("date", F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), (F.col("id") / 30).alias("s"), F.sin("id").alias("y"), (1.0 + F.col("id") % 3).alias("sample_weight"))
    return rows, panel.fold_assignments(dates, [panel.Fold(1, (days[0], days[1]), (days[2], days[3]), (days[4], days[5]))])


def test_no_pass_over_a_fold_gathers_its_splits(spark):
    told = {}

    class Estimator:
        def fit(self, df):
            told["plan"] = df._jdf.queryExecution().executedPlan().toString()
            told["means"] = {r.is_valid: r.w for r in df.groupBy("is_valid").agg(F.avg("weight").alias("w")).collect()}
            raise Seen

    rows, folds = inputs(spark)
    with pytest.raises(Seen):
        model.train_folds(rows, folds, model.Contract(("s",)), "y", factory=Estimator)
    assert told["means"] == {False: pytest.approx(1), True: pytest.approx(1)}
    assert "hashpartitioning(split" not in told["plan"] and "Window" not in told["plan"]


def test_a_training_leaves_its_predictions_only(spark):
    root = Path(storage._checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: {str(p) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    before = size()
    rows, folds = inputs(spark)
    out = model.train_folds(rows, folds, model.Contract(("s",)), "y", params={"n_estimators": 3, "min_child_samples": 5})
    left = {Path(p).relative_to(root).parts[0] for p in size() - before}
    assert out["predictions"].count() == 120 and len(left) == 1 and left.pop().startswith("predictions-")
    assert spark.conf.get(storage.CLEANUP) == "false"
