"""Checks inside the plan: they stop broken queries and stay where they are written."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.functions import checks
from panelforge.operators import membership, periods
from panelforge.operators.periods import Period, Segment

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(10)]
CODES = ["000001", "000002", "600003", "600004"]


def rows(spark):
    return spark.createDataFrame([(d, c, None if d == D[9] else 1.0) for d in D for c in CODES], "date date, stock_code string, label double")


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_a_check_above_a_join_sees_joined_rows_only(spark, tmp_path, how, broadcast):
    rows(spark).write.parquet(str(tmp_path / "t"))
    p, days = spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(d,) for d in D[:9]], "date date")
    days = F.broadcast(days) if broadcast else days.hint("merge")
    good = checks.passing(p.join(days, "date", how), F.col("label").isNotNull(), "labels", ["date"])
    assert good.count() == 36 == len(good.collect())
    bad = checks.passing(p.join(spark.createDataFrame([(d,) for d in D], "date date"), "date", how), F.col("label").isNotNull(), "labels", ["date"])
    with pytest.raises(PySparkException, match="labels: 2024-01-10"):
        bad.collect()
    # in the optimised plan the check stands above the join
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("raise_error") < plan.index("Join")


def test_later_filters_and_joins_do_not_excuse_a_broken_row(spark):
    checked = checks.passing(rows(spark), F.col("label").isNotNull(), "labels", ["date"])
    for later in (checked.where(F.col("date") == D[0]), checked.join(spark.createDataFrame([(D[0],)], "date date"), "date"), checked.select("date").distinct()):
        with pytest.raises(PySparkException, match="labels"):
            later.collect()


def test_unique_and_matched_above_a_join(spark):
    twice = rows(spark).unionByName(rows(spark).where(F.col("date") == D[9]))
    days = spark.createDataFrame([(d,) for d in D[:9]], "date date")
    assert checks.unique(twice.join(days, "date"), ["date", "stock_code"], "rows").count() == 36
    with pytest.raises(PySparkException, match="repeats keys"):
        checks.unique(twice, ["date", "stock_code"], "rows").join(days, "date").collect()
    few = rows(spark).where(F.col("date") < D[9]).select("date").distinct()
    assert checks.matched(rows(spark).join(days, "date"), few, ["date"], "dates").count() == 36
    with pytest.raises(PySparkException, match="dates: 2024-01-10"):
        checks.matched(rows(spark), few, ["date"], "dates").join(days, "date").collect()


def test_alongside_reads_the_other_frame_and_adds_nothing(spark):
    df, told = rows(spark), spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    good = checks.alongside(df, told, F.col("n") > 0, "counts", ["k"])
    assert good.columns == df.columns and good.count() == 40 and sorted(map(str, good.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(PySparkException, match="counts: a"):
        checks.alongside(df, told, F.col("n") > 1, "counts", ["k"]).collect()


# ---- stitched dates


def predictions(spark):
    # fold 1: train D0-1, valid D2-3, test D4-5; fold 2: test D6-7
    split = {**{k: (1, "train") for k in (0, 1)}, **{k: (1, "valid") for k in (2, 3)}, **{k: (1, "test") for k in (4, 5)}, **{k: (2, "test") for k in (6, 7)}}
    return spark.createDataFrame([(*split[k], D[k], c, float(k)) for k in range(8) for c in CODES], "fold_id int, split string, date date, stock_code string, s double")


def test_missing_dates_of_a_segment_stop_the_stitching(spark):
    folds = spark.createDataFrame([(1, "train", 8, 2, D[0], D[1]), (1, "valid", 8, 2, D[2], D[3]), (1, "test", 8, 2, D[4], D[5]), (2, "train", 0, 0, D[0], D[3]), (2, "valid", 0, 0, D[4], D[5]), (2, "test", 8, 2, D[6], D[7])], "fold_id int, split string, row_count long, date_count long, start_date date, end_date date")
    segments = periods.training_segments(folds)
    assert [(s.fold_id, s.split, s.date_count) for s in segments] == [(1, "train", 2), (1, "valid", 2), (1, "test", 2), (2, "test", 2)]
    out = periods.stitch(predictions(spark), segments, "s")
    assert out.count() == 32 and {(r.source_fold_id, r.source_split) for r in out.collect()} == {(s.fold_id, s.split) for s in segments}
    for gone in (F.col("date") == D[5], F.col("fold_id") == 2):
        with pytest.raises(PySparkException, match="stitched dates"):
            periods.stitch(predictions(spark).where(~gone), segments, "s").collect()
    free = [Segment(1, "test", D[4], D[5])]
    assert periods.stitch(predictions(spark).where(F.col("date") != D[5]), free, "s").count() == 4


# ---- signal comparison


def compared(spark, template=None, panel=None, returns=None, buckets=2):
    base = predictions(spark).where("split = 'test'")
    template = base.select("fold_id", "split", "date", "stock_code") if template is None else template
    panel = base.select("date", "stock_code", (F.col("stock_code").cast("int") % 7).cast("double").alias("x"), F.lit(None).cast("double").alias("none")) if panel is None else panel
    returns = base.select("date", "stock_code", (F.col("stock_code").cast("int") % 5 / 100).alias("value")) if returns is None else returns
    return periods.compare_signals(panel, template, returns, {"x": "x", "empty": "none"}, [Period("p", D[4], D[7])], buckets), base


def test_comparison_has_empty_buckets_and_counts_names(spark):
    out, _ = compared(spark, buckets=6)
    got = {(r.signal_id, r.bucket_index): r for r in out.collect()}
    assert {k for s, k in got if s == "x"} == set(range(1, 7))
    assert got["x", 1].mean_selected == 1.0 and got["x", 6].mean_selected == 0.0 and got["x", 6].valid_day_count == 0
    assert all(r.signal_id == "x" or r.valid_day_count == 0 for r in got.values())


def test_broken_rows_stop_the_comparison(spark):
    _, base = compared(spark)
    template, panel = base.select("fold_id", "split", "date", "stock_code"), base.select("date", "stock_code", F.lit(1.0).alias("x"), F.lit(1.0).alias("none"))
    returns = base.select("date", "stock_code", F.lit(0.01).alias("value"))
    one = lambda df: df.unionByName(df.limit(1))
    broken = [
        ({"template": one(template)}, "template repeats"),
        ({"panel": one(panel)}, "panel repeats"),
        ({"returns": one(returns)}, "returns repeats"),
        ({"returns": returns.withColumn("value", F.lit(-2.0))}, "above -1"),
        ({"panel": panel.where(F.col("date") != D[4])}, "template rows without panel rows"),
        ({"template": template.withColumn("stock_code", F.lit(""))}, "without a date or stock"),
        ({"panel": one(panel.withColumn("date", F.lit(None).cast("date")))}, "without a date or stock"),
    ]
    for args, said in broken:
        with pytest.raises(PySparkException, match=said):
            compared(spark, **args)[0].collect()
    with pytest.raises(ValueError, match="none"):
        compared(spark, panel=panel.drop("none"))


# ---- dataset


def test_datasets_hold_finite_metrics_and_agreeing_flags(spark):
    df = rows(spark).withColumns({"index_membership_any_unknown": F.lit(True), "index_membership_all_known": F.lit(False)})
    assert membership.valid_dataset(df, ["label"]).count() == 40
    for broken, said in ((df.withColumn("label", F.lit(float("inf"))), "finite"), (df.withColumn("label", F.lit(float("nan"))), "finite"), (df.withColumn("index_membership_all_known", F.lit(True)), "contradict"), (df.limit(0), "empty")):
        with pytest.raises(PySparkException, match=said):
            membership.valid_dataset(broken, ["label"]).collect()
