"""Panel operators on small frames with hand-computed results."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.functions import checks, keys
from panelforge.operators import evaluate, membership, model, nav, neutralize, panel, periods, quality, returns, xsection
from panelforge.sources import bundles, readers, writers

D = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11)]
CODES = ["000001", "000002", "600003", "600004"]


def one(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*df.columns[:2]).collect()]


# ---- keys


def test_stock_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "000001.SZ", "1.0", "600000.SH", None, " 300001 ", "1234567", "nan")], "v string")
    get = lambda rule: [r[0] for r in df.select(keys.stock_code(F.col("v"), rule)).collect()]
    assert get("market") == ["000001", "000001", "000001", "600000", "", "300001", "1234567", "nan"]
    assert get("decimal") == ["000001", "000001.SZ", "000001", "600000.SH", "", "300001", "1234567", "nan"]
    assert get("any") == ["000001", "000001", "000001", "600000", "", "300001", "1234567", ""]
    assert get("none")[:2] == ["000001", "000001.SZ"]


def test_boards(spark):
    rows = [("302132", "创业板", "SZSE"), ("688001", None, None), ("600000", "主板", "SH"), ("000001", "中小板", "SZ"), ("830001", "", ""), ("999999", None, None), ("1", "star-board", "x")]
    got = spark.createDataFrame(rows, "c string, m string, e string").select(keys.inferred_board(F.col("c"), F.col("m"), F.col("e")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in got] == [("CHINEXT", "exchange_market_mapping"), ("STAR", "prefix_fallback"), ("SSE_MAIN", "exchange_market_mapping"), ("SZSE_MAIN", "exchange_market_mapping"), ("BSE", "prefix_fallback"), ("UNKNOWN_BOARD", "unknown"), ("STAR", "market_type_alias")]
    board = spark.createDataFrame([("1", "CHINEXT", "SZSE"), ("2", "MAIN", "SZSE")], "stock_code string, listing_board_code string, exchange_code string")
    assert [(r.listing_board_segment, r.is_main_board) for r in membership.board_dimension(board).orderBy("stock_code").collect()] == [("CHINEXT", False), ("SZSE_MAIN", True)]


def test_dates_labels_and_buckets(spark):
    df = spark.createDataFrame([("20240102",), ("2024-01-02",), ("2024/1/2",), ("2024-01-02 15:00:00",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(keys.parsed_date(F.col("v"))).collect()] == [D[0]] * 4 + [None, None]
    flags = spark.createDataFrame([(0, 1, 0, 0), (0, 0, 0, 0), (None, 1, 0, 0)], ", ".join(f"{c} int" for c in keys.INDEX_FLAGS))
    assert [r[0] for r in flags.select(keys.index_bucket("UNKNOWN_INDEX")).collect()] == ["CSI500", "NON_INDEX", "UNKNOWN_INDEX"]
    labels = spark.createDataFrame([("3.0",), ("2.5",), ("a",)], "v string").select(keys.category_label(F.col("v")))
    assert [r[0] for r in labels.collect()] == ["3", "2.5", "a"]


# ---- cross-sections


def test_centered_rank_and_decile(spark):
    df = spark.createDataFrame([("d", c, v) for c, v in zip("abcd", (10.0, 20.0, 20.0, None), strict=True)], "date string, stock_code string, v double")
    out = df.withColumn("r", xsection.centered_rank("v")).withColumn("k", xsection.decile("v")).orderBy("stock_code").collect()
    assert [r.r for r in out] == [pytest.approx(-1 / 3), pytest.approx(1 / 6), pytest.approx(1 / 6), None]
    assert [r.k for r in out] == [3, 6, 9, -1]


def test_robust_z_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    x[0] = 100
    df = spark.createDataFrame([("d", str(i), float(v)) for i, v in enumerate(x)] + [("e", "q", 1.0), ("e", "r", 1.0)], "date string, stock_code string, v double")
    got = {(r.date, r.stock_code): r.z for r in xsection.add_robust_z(df, "v", "z").collect()}
    c = np.clip(x, *np.quantile(x, [0.01, 0.99]))
    m = np.median(c)
    want = np.clip((c - m) / (1.4826 * np.median(np.abs(c - m))), -5, 5)
    assert [got["d", str(i)] for i in range(60)] == pytest.approx(list(want))
    assert got["e", "q"] == 0


@pytest.mark.parametrize("q", [2, 3, 5, 10])
def test_quantile_buckets_follow_equal_positions(spark, q):
    n = 23
    df = spark.createDataFrame([("d", f"{i:03d}", float(i)) for i in range(n)], "date string, stock_code string, v double")
    got = [r.k for r in df.withColumn("k", xsection.quantile_bucket("v", q, ("date",))).orderBy("stock_code").collect()]
    edges = [1 + k / q * (n - 1) for k in range(1, q + 1)]
    assert got == [next(k for k, e in enumerate(edges, 1) if rn <= e + 1e-9) for rn in range(1, n + 1)]


def test_transform_domains(spark):
    df = spark.createDataFrame([("d", c, v) for c, v in zip("abcd", (0.0, 1.0, 2.0, -1.0), strict=True)], "date string, stock_code string, v double")
    out = xsection.add_rank_and_z(df, "v", "s", "log_positive").orderBy("stock_code").collect()
    assert [r.s_rank for r in out] == [None, -0.25, 0.25, None]
    with pytest.raises(ValueError, match="unknown transform"):
        xsection.transformed(F.col("v"), "cube")


# ---- rank buckets


def predictions(spark, scores, days=D[:2], split="test"):
    return spark.createDataFrame([(1, split, d, c, s) for d, row in zip(days, scores, strict=True) for c, s in zip(CODES, row, strict=True)], "fold_id int, split string, date date, stock_code string, s double")


def prices(spark, rows, days=D[:2]):
    return spark.createDataFrame([(d, c, r) for d, row in zip(days, rows, strict=True) for c, r in zip(CODES, row, strict=True)], "date date, stock_code string, value double")


def test_fixed_buckets_compound(spark):
    p = predictions(spark, [[4.0, 3.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0]])
    r = prices(spark, [[0.10, 0.06, -0.02, -0.04], [-0.01, 0.01, 0.03, 0.05]])
    buckets = [nav.RankBucket("top", 1, 2), nav.RankBucket("bottom", 3, 4)]
    out = nav.rank_bucket_nav(p, r, "s", buckets=buckets)["nav"].orderBy("bucket_index", "date").collect()
    assert [x.bucket_return for x in out] == pytest.approx([0.08, 0.04, -0.03, 0.0])
    assert [x.gross_nav for x in out] == pytest.approx([1.08, 1.1232, 0.97, 0.97])


def test_missing_scores_and_returns(spark):
    p = predictions(spark, [[4.0, 3.0, float("nan"), 1.0]], D[:1])
    r = prices(spark, [[0.02, None, 0.5, -0.01]], D[:1])
    out = nav.bucket_returns(nav.rank_scores(p, "s"), r, buckets=[nav.RankBucket("top", 1, 2), nav.RankBucket("next", 3, 4)]).orderBy("bucket_index").collect()
    top, rest = out
    assert (top.eligible_count, top.selected_count, top.valid_return_count, top.missing_return_count, top.bucket_return) == (3, 2, 1, 1, 0.02)
    assert rest.bucket_return == -0.01


def test_equal_count_buckets(spark):
    rows = [(1, "test", d, f"{k:06d}", float(k)) for d, n in ((D[0], 10), (D[1], 8)) for k in range(n)]
    ranked = nav.rank_scores(spark.createDataFrame(rows, "fold_id int, split string, date date, stock_code string, s double"), "s")
    out = nav.bucket_frame(ranked, 3).orderBy("date", "bucket_index").collect()
    assert [x.rank_end - x.rank_start + 1 for x in out] == [4, 3, 3, 3, 3, 2]
    assert [x.rank_start for x in out] == [1, 5, 8, 1, 4, 7]
    assert [x.rank_end for x in out] == [4, 7, 10, 3, 6, 8]
    counts = {(r.date, r.bucket_index): r["count"] for r in nav.assign_buckets(ranked, 3).groupBy("date", "bucket_index").count().collect()}
    assert counts == {(x.date, x.bucket_index): x.rank_end - x.rank_start + 1 for x in out}


def test_empty_buckets_and_stale_nav(spark):
    p = predictions(spark, [[4.0, 3.0, None, None], [2.0, 1.0, None, None]])
    r = prices(spark, [[0.08, 0.08, None, None], [None, None, None, None]])
    tables = nav.rank_bucket_nav(p, r, "s", bucket_count=3)
    out = tables["nav"].where("bucket_index = 1").orderBy("date").collect()
    assert [(x.applied_return, x.nav_stale_flag) for x in out] == [(0.08, False), (0.0, True)]
    assert [x.gross_nav for x in out] == pytest.approx([1.08, 1.08])
    empty = tables["nav"].where("bucket_index = 3").first()
    assert (empty.selected_count, empty.rank_start, empty.rank_end, empty.bucket_return) == (0, 3, 2, None)


def test_composition_and_constituents(spark):
    p = predictions(spark, [[4.0, 3.0, 2.0, 1.0], [4.0, 3.0, 2.0, 1.0]])
    r = prices(spark, [[0.01] * 4] * 2)
    feats = [(d, c, i, 1.0, 1.0, 1.0, m, k) for d, industries in zip(D[:2], (["bank", "bank", "tech", "tech"], ["bank", "tech", "bank", "tech"]), strict=True) for c, i, m, k in zip(CODES, industries, (0.5, 0.0, -0.25, -0.25), range(4), strict=True)]
    features = spark.createDataFrame(feats, "date date, stock_code string, industry string, market_cap double, log_mcap double, log_mcap_z double, mcap_rank double, size_decile int")
    out = nav.rank_bucket_nav(p, r, "s", features=features, bucket_count=2)
    bank = out["industry_summary"].where("industry = 'bank' and bucket_index = 1").first()
    assert (bank.mean_bucket, bank.mean_universe, bank.mean_active, bank.positive_rate) == (0.75, 0.5, 0.25, 0.5)
    assert out["size_summary"].where("metric = 'mcap_rank' and bucket_index = 1").first().mean_active == 0.25
    assert {(x.stock_code, x.weight) for x in out["constituents"].where("bucket_index = 1").collect()} == {("000001", 0.5), ("000002", 0.5)}
    with pytest.raises(PySparkException, match="lack composition"):
        nav.rank_bucket_nav(p, r, "s", features=features.where(F.col("stock_code") != "000001"), bucket_count=2)["industry_daily"].collect()
    with pytest.raises(PySparkException, match="repeats keys"):
        nav.rank_bucket_nav(p.union(p), r, "s", bucket_count=2)["nav"].collect()
    with pytest.raises(PySparkException, match="above -1"):
        nav.rank_bucket_nav(p, prices(spark, [[-1.0] * 4] * 2), "s", bucket_count=2)["nav"].collect()


def test_periods_restart(spark):
    days = D[:4]
    rows = [(1, "test", d, k, f"b{k}", r, 1, 1 if r is not None else 0, 0 if r is not None else 1) for d, both in zip(days, ((0.1, 0.02), (-0.2, None), (0.05, 0.02), (0.05, None)), strict=True) for k, r in enumerate(both, 1)]
    daily = spark.createDataFrame(rows, "fold_id int, split string, date date, bucket_index int, bucket_label string, bucket_return double, selected_count int, valid_return_count int, missing_return_count int")
    spans = [periods.Period("p1", days[0], days[1]), periods.Period("p2", days[2], days[3])]
    out = {(r.period, r.bucket_index): r for r in periods.period_summary(daily, spans).collect()}
    assert out["p1", 1].final_nav == pytest.approx(0.88)
    assert out["p1", 1].max_drawdown == pytest.approx(-0.20)
    assert out["p1", 1].longest_underwater_days == 1
    assert (out["p2", 1].final_nav, out["p2", 1].longest_underwater_days) == (pytest.approx(1.1025), 0)
    assert (out["p2", 2].final_nav, out["p2", 2].valid_day_count, out["p2", 2].empty_day_count) == (pytest.approx(1.02), 1, 1)
    with pytest.raises(PySparkException, match="repeats keys"):
        periods.period_summary(daily.union(daily.withColumn("fold_id", F.lit(2))), spans).collect()
    with pytest.raises(ValueError, match="overlap"):
        checks.check_periods([spans[0], periods.Period("x", days[1], days[2])])


def test_alignment(spark):
    reference = spark.createDataFrame([(d, c, v) for d in D[:2] for c, v in zip(CODES, (4.0, 3.0, 2.0, 1.0), strict=True)], "date date, stock_code string, alpha double")
    candidate = predictions(spark, [[4.0, 3.0, 1.0, 2.0], [1.0, 2.0, 3.0, 4.0]])
    out = one(periods.daily_alignment(reference, candidate, "alpha", "s", 2).select("date", "spearman", "top_overlap"), "spearman", "top_overlap")
    assert out == [(pytest.approx(0.8), 2), (pytest.approx(-1.0), 0)]


def test_stitching(spark):
    rows = [(f, s, d, "000001", float(f)) for f, s, d in ((1, "train", D[0]), (1, "valid", D[1]), (1, "test", D[2]), (2, "train", D[1]), (2, "test", D[3]))]
    p = spark.createDataFrame(rows, "fold_id int, split string, date date, stock_code string, s double")
    segments = periods.source_segments({1: {"train": (D[0], D[0]), "valid": (D[1], D[1]), "test": (D[2], D[2])}, 2: {"train": (D[0], D[1]), "test": (D[3], D[3])}})
    out = periods.stitch(p, segments, "s").orderBy("date").collect()
    assert [(r.date, r.source_fold_id) for r in out] == [(D[0], 1), (D[1], 1), (D[2], 1), (D[3], 2)]
    with pytest.raises(PySparkException, match="repeats keys"):
        periods.stitch(p.union(p), segments, "s").collect()
    with pytest.raises(ValueError, match="overlap"):
        periods.stitch(p, [*segments, periods.Segment(2, "train", D[0], D[1])], "s")


# ---- evaluation


def test_ic_is_averaged_over_days_not_pooled(spark):
    p = predictions(spark, [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]]).withColumn("y", F.when(F.col("date") == D[0], F.col("s")).otherwise(-F.col("s")) * 1.0)
    ic = evaluate.daily_ic(p, ["s"], "y")
    assert one(ic.select("date", "ic", "rank_ic"), "ic", "rank_ic") == [(pytest.approx(1.0), pytest.approx(1.0)), (pytest.approx(-1.0), pytest.approx(-1.0))]
    assert evaluate.summarize_ic(ic).first().mean_ic == pytest.approx(0.0)


def test_spread_skips_constant_scores(spark):
    p = predictions(spark, [[1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 1.0]]).withColumn("y", F.col("stock_code").cast("double"))
    out = evaluate.top_bottom_spread(p, ["s"], "y", 2).collect()
    assert [(r.date, r.top_count, r.bottom_count) for r in out] == [(D[0], 2, 2)]


def test_feature_gain_shares(spark):
    gains = spark.createDataFrame([(1, "a", 3.0, 1.0), (1, "b", 1.0, 1.0), (2, "a", 0.0, 0.0), (2, "b", float("nan"), 0.0)], "fold_id int, feature string, importance_gain double, importance_split double")
    shares = evaluate.feature_gain(gains)
    assert {r.fold_id: r.s for r in shares.groupBy("fold_id").agg(F.sum("gain_share").alias("s")).collect()} == {1: 1.0, 2: 0.0}
    roles = spark.createDataFrame([("a", "signal"), ("b", "context")], "feature string, role string")
    summary = evaluate.summarize_feature_gain(shares, roles)
    assert summary.where("feature = 'a'").first().mean_gain_share == 0.375
    assert {r.role: r.top_feature for r in evaluate.summarize_roles(summary).collect()} == {"signal": "a", "context": "b"}
    with pytest.raises(PySparkException, match="repeats keys"):
        evaluate.summarize_feature_gain(shares, roles.union(roles)).collect()


def test_inconsistent_copies_are_rejected(spark):
    p = predictions(spark, [[1.0] * 4] * 2).withColumn("y", F.lit(1.0))
    good = p.select("date", "stock_code", F.lit(1.0).alias("y"), F.lit("i").alias("industry"))
    assert evaluate.evaluation_frame(p, good, ["industry"], ["y"]).count() == 8
    with pytest.raises(PySparkException, match="differ"):
        evaluate.evaluation_frame(p, good.withColumn("y", F.lit(1.1)), ["industry"], ["y"]).collect()
    with pytest.raises(PySparkException, match="without panel rows"):
        evaluate.evaluation_frame(p, good.limit(0), ["industry"]).collect()
    for twice in ((p.union(p), good), (p, good.union(good))):
        with pytest.raises(PySparkException, match="repeats keys"):
            evaluate.evaluation_frame(*twice, ["industry"]).collect()


# ---- panels and folds


def context(spark, days=D[:2]):
    rows = [(str(d), c, i, b, *f, cap, 5.0 + k, 0.1 * k) for d in days for k, (c, i, b, f, cap) in enumerate(zip(CODES, ("bank", "tech", None, " "), ("main",) * 4, ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1)), (10.0, 20.0, 30.0, 40.0), strict=True))]
    return spark.createDataFrame(rows, "date string, stock_code string, industry string, board string, is_csi300 int, is_csi500 int, is_csi1000 int, is_csi2000 int, market_cap double, amount_k double, turnover double")


def test_universe_before_labels(spark):
    signal = spark.createDataFrame([(d, c, v) for d in D[:2] for c, v in zip(CODES, (1.0, 2.0, 3.0, 4.0), strict=True)], "date date, stock_code string, value double")
    label = spark.createDataFrame([(d, c, 0.1) for d in D[:2] for c in CODES if not (d == D[0] and c == CODES[3])], "date date, stock_code string, value double")
    out = panel.build_panel(context(spark), label, {"alpha": signal}, {"alpha": "log_positive"})
    first = out.where(F.col("date") == D[0]).orderBy("stock_code").collect()
    assert [r.alpha_rank for r in first] == [-0.375, -0.125, 0.125]
    assert {r.industry for r in out.collect()} == {"bank", "tech", "unknown_industry"}
    assert out.agg(F.sum("sample_weight")).first()[0] == pytest.approx(7.0, abs=0.01)
    after = panel.build_panel(context(spark), label, {"alpha": signal}, {"alpha": "identity"}, universe_first=False)
    assert {round(r[0], 9) for r in after.groupBy("date").agg(F.sum("sample_weight")).select(F.col("sum(sample_weight)")).collect()} == {3.5}
    with pytest.raises(PySparkException, match="repeats keys"):
        panel.build_panel(context(spark).union(context(spark)), label, {"alpha": signal}, {"alpha": "identity"}).collect()
    with pytest.raises(PySparkException, match="signals repeats keys"):
        panel.build_panel(context(spark), label, {"alpha": signal.union(signal)}, {"alpha": "identity"}).collect()


def test_folds_and_embargo(spark):
    dates = spark.createDataFrame([(d,) for d in D], "date date")
    fold = panel.Fold(1, (D[0], D[3]), (D[4], D[5]), (D[6], D[7]))
    whole = {(r.split, r.date) for r in panel.fold_assignments(dates, [fold]).collect()}
    assert {s for s, d in whole if d == D[3]} == {"train"} and len(whole) == 8
    short = {(r.split, r.date) for r in panel.fold_assignments(dates, [fold], 2).collect()}
    assert whole - short == {("train", D[2]), ("train", D[3]), ("valid", D[4]), ("valid", D[5])}
    with pytest.raises(PySparkException, match="repeats keys"):
        panel.fold_assignments(dates, [panel.Fold(1, (D[0], D[4]), (D[4], D[5]), (D[6], D[7]))]).collect()
    with pytest.raises(ValueError, match="before test"):
        panel.assert_fold_order(panel.fold_assignments(dates, [panel.Fold(1, (D[4], D[5]), (D[0], D[1]), (D[6], D[7]))]))


def test_one_hots_and_constituents(spark):
    c = panel.prepare_context(context(spark))
    wide = panel.one_hot(c, "industry", "industry", "unknown")
    assert [x for x in wide.columns if "__" in x] == ["industry__bank", "industry__tech", "industry__unknown_industry"]
    hot = panel.index_one_hot(c.withColumn("u", F.col("stock_code") == "600003"), ["u"]).where(F.col("date") == D[0]).orderBy("stock_code").collect()
    assert [r.index__UNKNOWN_INDEX for r in hot] == [0, 0, 1, 0] and hot[0].index__CSI300 == 1
    assert panel.index_constituents(c).count() == 6
    with pytest.raises(PySparkException, match="overlap"):
        panel.index_one_hot(c.withColumn("is_csi500", F.lit(1))).collect()


def test_signal_orientation(spark):
    by_date = spark.createDataFrame([("2024-01-02", 1.0, 2.0), ("2024-01-03", None, 4.0)], "d string, `000001` double, `000002` double")
    by_code = spark.createDataFrame([("000001", 1.0, None), ("000002", 2.0, 4.0)], "c string, `2024-01-02` double, `2024-01-03` double")
    want = {(D[0], "000001", 1.0), (D[0], "000002", 2.0), (D[1], "000002", 4.0)}
    for m in (by_date, by_code):
        assert {tuple(r) for r in panel.signal_to_long(m, "v").select("date", "stock_code", "v").collect()} == want
    with pytest.raises(ValueError, match="which axis"):
        panel.signal_to_long(spark.createDataFrame([("x", 1.0)], "c string, y double"), "v")
    back = panel.long_to_wide(spark.createDataFrame(sorted(want), "date date, stock_code string, value double")).orderBy("date").collect()
    assert [r["000002"] for r in back] == [2.0, 4.0]


# ---- returns and membership


def adjusted(spark, factors, raw=-0.75, **config):
    calendar = spark.createDataFrame([(d,) for d in D], "date date")
    f = spark.createDataFrame([(d, "000001", x) for d, x in factors], "date date, stock_code string, factor double")
    r = spark.createDataFrame([(D[0], "000001", raw)], "date date, stock_code string, value double")
    return returns.adjust_returns(r, f, calendar, returns.AdjustmentConfig(**config)).first()


def test_return_adjustment(spark):
    out = adjusted(spark, [(D[1], 1.0), (D[2], 4.0)])
    assert (out.return_adjusted, out.buy_date, out.sell_date, out.action) == (0.0, D[1], D[2], "adjusted_by_factor_ratio")
    assert adjusted(spark, [(D[1], 2.0), (D[2], 2.0)]).action == "unchanged_no_factor_change"
    reversal = list(zip(D[:4], (108.031, 66.3145, 108.031, 108.031), strict=True))
    kept = adjusted(spark, reversal)
    assert (kept.return_adjusted, kept.suspicious_flag, kept.action) == (-0.75, True, "kept_raw_suspicious_factor_reversal")
    assert adjusted(spark, reversal, suspicious="null").return_adjusted is None
    missing = adjusted(spark, [(D[1], 1.0)])
    assert (missing.return_adjusted, missing.action) == (None, "nan_missing_factor")
    assert adjusted(spark, [(D[1], 1.0), (D[2], 0.0)]).action == "nan_invalid_factor"


def test_rolling_liquidity(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), "1", float(k) if k != 3 else -1.0, 1.0, 0.5) for k in range(30)]
    out = returns.rolling_liquidity(spark.createDataFrame(rows, "date date, stock_code string, amount_k double, volume double, turnover double")).orderBy("date").collect()
    assert out[5].amount20 is None
    assert out[6].amount20 == pytest.approx(np.mean([1, 2, 4, 5, 6]))
    assert out[29].amount20 == pytest.approx(np.mean(range(10, 30)))
    assert out[29].logADV20 == pytest.approx(np.log1p(1))


def test_asof_membership(spark):
    rows = spark.createDataFrame([(d, c) for d in D[:4] for c in CODES[:2]], "date date, stock_code string")
    snaps = spark.createDataFrame([(D[1], CODES[0]), (D[3], CODES[1])], "snapshot_date date, stock_code string")
    out = {(r.date, r.stock_code): r.m for r in membership.asof_membership(rows, snaps, "m").collect()}
    assert [out[d, CODES[0]] for d in D[:4]] == [0, 1, 1, 0]
    assert [out[d, CODES[1]] for d in D[:4]] == [0, 0, 0, 1]


def test_pit_membership_marks_unknown(spark):
    specs = (membership.IndexSpec("is_a", "A", 2, 3), membership.IndexSpec("is_b", "B", 1, 3))
    dates = spark.createDataFrame([(D[0],)], "date date")
    universe = spark.createDataFrame([(D[0], c) for c in CODES], "date date, stock_code string")
    manifest = spark.createDataFrame([("A", D[0], "complete")], "index_name string, date date, quality_status string")
    rows = [("A", D[0], c, 50.0, "complete") for c in CODES[:2]]
    schema = "index_name string, date date, stock_code string, weight double, quality_status string"
    q = membership.membership_quality(dates, manifest, spark.createDataFrame(rows, schema), specs)
    out = membership.membership_panel(universe, q, spark.createDataFrame(rows, schema), specs).orderBy("stock_code").collect()
    assert [r.is_a for r in out] == [True, True, False, False]
    assert all(r.is_b_unknown and not r.is_b and not r.is_a_unknown and r.index_membership_any_unknown for r in out)
    for bad, why in (([*rows, rows[0]], "duplicate_member_rows=1"), (rows[:1], "observed_member_count=1"), ([(*r[:3], 10.0, r[4]) for r in rows], "weight_sum"), ([(*r[:4], "partial") for r in rows], "partition_quality_status=partial")):
        got = membership.membership_quality(dates, manifest, spark.createDataFrame(bad, schema), specs).where("flag = 'is_a'").first()
        assert not got.reliable and why in got.unreliable_reasons


def test_daily_dataset_needs_matches(spark):
    daily = spark.createDataFrame([(D[0], "000001", 1.0)], "date date, stock_code string, volume double")
    industry = spark.createDataFrame([("000001", "bank")], "stock_code string, industry string")
    board = spark.createDataFrame([("000001", "MAIN", "SZ")], "stock_code string, listing_board_code string, exchange_code string")
    flags = spark.createDataFrame([(D[0], "000001", True)], "date date, stock_code string, is_a boolean")
    assert membership.daily_dataset(daily, industry, board, flags).first().listing_board_segment == "SZSE_MAIN"
    for k in ("industry", "membership"):
        args = {"industry": industry, "board": board, "membership": flags}
        args[k] = args[k].limit(0)
        with pytest.raises(PySparkException, match=f"without {k}"):
            membership.daily_dataset(daily, *args.values()).collect()
        assert membership.daily_dataset(daily, *args.values(), required={k: False}).count() == 1


# ---- neutralisation, models, quality


def exposures(spark, n=40):
    rng = np.random.default_rng(0)
    rows = [(d, f"{k:06d}", ("bank", "tech", "energy")[k % 3], ("main", "growth")[k % 2], k % 5 == 0, k % 5 == 1, k % 5 == 2, k % 5 == 3, float(10 + 3 * k), float(rng.normal() + k % 3 + 0.1 * (k % 2))) for d in D[:2] for k in range(n)]
    flags = ", ".join(f"{c} boolean" for c in keys.INDEX_FLAGS)
    return spark.createDataFrame(rows, f"date date, stock_code string, industry string, board string, {flags}, market_cap double, value double").withColumns({c: F.col(c).cast("int") for c in keys.INDEX_FLAGS})


def test_exact_neutralisation_removes_exposures(spark):
    e = exposures(spark)
    out = neutralize.neutralize(e.select("date", "stock_code", "value"), e, neutralize.EXACT).cache()
    for c in ("industry", "board"):
        assert all(r.largest_group_mean < 1e-10 for r in neutralize.largest_group_mean(out, e, c).collect())
    assert abs(out.agg(F.avg("residual")).first()[0]) < 1e-10
    assert out.agg(F.avg("rank_label")).first()[0] == pytest.approx(0)
    joined = out.join(e.drop("value"), ["date", "stock_code"])
    for c in keys.INDEX_FLAGS:
        assert abs(joined.agg(F.sum(F.col("residual") * F.col(c))).first()[0]) < 1e-8


def test_neutralisation_skips_and_winsorises(spark):
    e = exposures(spark)
    values = e.select("date", "stock_code", F.when(F.col("stock_code") == "000007", 1.25 * 30).otherwise(F.col("value")).alias("value"))
    exact = neutralize.neutralize(values, e, neutralize.EXACT).agg(F.max(F.abs(F.col("residual")))).first()[0]
    assert neutralize.neutralize(values, e).agg(F.max(F.abs(F.col("residual")))).first()[0] < exact
    reasons = lambda df, x, **k: {r.skipped_reason for r in neutralize.neutralize(df, x, neutralize.NeutralizeConfig(**k)).collect()}
    assert reasons(values, e, start=D[1]) == {"before_start_date", None}
    assert reasons(values, e.where(F.col("date") == D[0])) == {"missing_exposure_date", None}
    assert reasons(values, e, least_rows=100) == {"too_few_valid_observations"}
    assert reasons(values.where(F.col("stock_code") < "000005"), e, least_rows=1) == {"too_few_observations_for_design"}
    # a date needs more rows than columns and buffer: 40 rows, and the design's columns
    columns = neutralize.neutralize(values, e).first().n_columns
    assert reasons(values, e, column_buffer=39 - columns) == {None}
    assert reasons(values, e, column_buffer=40 - columns) == {"too_few_observations_for_design"}
    for bad in ({"ridge": -1.0}, {"least_rows": 0}, {"column_buffer": -1}, {"winsor": (0.5, 0.5)}, {"winsor": (None, 0.0)}, {"eps": 0.0}):
        with pytest.raises(ValueError, match="must"):
            neutralize.NeutralizeConfig(**bad)
    with pytest.raises(PySparkException, match="repeats keys"):
        neutralize.neutralize(values.union(values), e).collect()


def test_neutralisation_diagnostics(spark):
    e = exposures(spark)
    values = e.select("date", "stock_code", F.when(F.col("stock_code") != "000003", F.col("value")).alias("value"))
    exact = {r.date: r for r in neutralize.neutralize_tables(values, e, neutralize.EXACT)["diagnostics"].collect()}
    assert set(exact) == {r.date for r in e.select("date").distinct().collect()}
    for r in exact.values():
        assert (r.n_total, r.n_valid_return, r.n_valid_exposure, r.n_used, r.missing_exposure_count) == (40, 39, 40, 39, 0)
        assert not r.skipped and r.skipped_reason is None and r.method == "lstsq" and r.neutralization_type == "exact_neutralization"
        assert "size_rank_norm" in r.continuous_columns_used.split(",")
        assert max(abs(r.residual_weighted_mean), r.max_abs_industry_mean_after, r.max_abs_board_mean_after, r.max_abs_continuous_exposure_after) < 1e-10
        assert 0 <= r.r2 <= 1 and r.residual_weighted_std > 0
    ridge = neutralize.neutralize_tables(values, e, neutralize.NeutralizeConfig(ridge=10.0))["diagnostics"].collect()
    assert all(r.method == "solve" and r.max_abs_industry_mean_after > 1e-3 for r in ridge)
    none = neutralize.neutralize_tables(values.withColumn("value", F.lit(None).cast("double")), e)["diagnostics"].first()
    assert (none.skipped_reason, none.n_valid_return, none.n_valid_exposure) == ("too_few_valid_observations", 0, 40)
    one = neutralize.neutralization_summary(neutralize.neutralize_tables(values, e, neutralize.NeutralizeConfig(start=D[1]))["diagnostics"]).first()
    assert (one.date_count, one.processed_date_count, one.skipped_date_count) == (len(exact), len(exact) - 1, 1)
    marked = neutralize.signal_neutralization_diagnostics({"s": values}, e, ["s"])
    kinds = {r.input_kind: r for r in neutralize.kind_summary(marked).collect()}
    assert set(kinds) == {"value", "rank"} and all(r.max_abs_board_mean_after < 1e-10 for r in kinds.values())
    with pytest.raises(ValueError, match="missing"):
        neutralize.signal_neutralization_diagnostics({"s": values}, e, ["t"])
    x, w = np.array([1.0, 2.0, 4.0]), np.array([0.5, 0.25, 0.25])
    assert neutralize.weighted_std(x) == pytest.approx(x.std()) and neutralize.weighted_std(x, w) == pytest.approx(1.5**0.5) and neutralize.weighted_std(x * 0, w) == 0.0


def test_risk_r2_matches_numpy(spark):
    e = exposures(spark).withColumn("size", F.log("market_cap"))
    daily, scores = neutralize.risk_r2(e, ["value"], ["industry", "board"], ["size"])
    day = e.where(F.col("date") == D[0]).toPandas().sort_values("stock_code")
    x = np.column_stack([np.ones(40), pd.get_dummies(day["industry"]), pd.get_dummies(day["board"]), day["size"]]).astype(float)
    y = day["value"].to_numpy()
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert daily.where(F.col("date") == D[0]).first().r2 == pytest.approx(1 - (res**2).sum() / ((y - y.mean()) ** 2).sum())
    assert scores.count() == 80


class Recorder:
    """A regressor that predicts the sum of features and records what it was fit on."""

    seen: list = []

    def __init__(self, **params):
        self.params = params

    def fit(self, df):
        Recorder.seen.append({(r.split, r.date) for r in df.select("split", "date").distinct().collect()})
        assert df.where("split = 'train'").agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
        return self

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array

        return df.withColumn("prediction", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x))


def test_models_see_no_test_rows(spark):
    rows = [(d, c, float(k), "a" if d < D[6] else "new", float(k), 1.0 + k) for d in D for k, c in enumerate(CODES)]
    p = spark.createDataFrame(rows, "date date, stock_code string, sig double, industry string, y_fwd double, sample_weight double")
    folds = panel.fold_assignments(p.select("date"), [panel.Fold(1, (D[0], D[3]), (D[4], D[5]), (D[6], D[7]))])
    roles = {"signal_features": ["sig"], "categorical_context": ["industry"], "continuous_context": [], "targets": ["y_fwd"], "keys": ["date", "stock_code"], "weights": ["sample_weight"]}
    c = model.contract(roles, "y_fwd")
    Recorder.seen.clear()
    out = model.train_folds(p, folds, c, "y_fwd", Recorder)["predictions"].collect()
    assert {s for s, _ in Recorder.seen[0]} == {"train", "valid"}
    assert {r.split for r in out} == {"valid", "test"}
    assert all(r.score_marginal == pytest.approx(r.pred_direct - r.pred_context_only) and r.score_marginal == r.y_true for r in out)
    unseen = [r for r in out if r.split == "test" and r.stock_code == CODES[0]]
    assert all(r.pred_direct == 1.0 for r in unseen)  # the position of UNKNOWN
    for bad in ({"signal_features": ["y_fwd"]}, {"categorical_context": ["sig"]}, {"signal_features": ["sample_weight"]}):
        with pytest.raises(ValueError, match="leak|role"):
            model.contract(roles | bad, "y_fwd")
    with pytest.raises(ValueError, match="not declared"):
        model.contract(roles, "other")
    with pytest.raises(ValueError, match="conflict"):
        model.monotone_signals(c, ["sig"], ["sig"])


def test_constraints_reach_the_factory_and_models_are_kept(spark, tmp_path):
    rows = [(d, c, float(k), "ab"[k % 2], 0.1 * k, 1.0) for d in D for k, c in enumerate(CODES)]
    p = spark.createDataFrame(rows, "date date, stock_code string, a_neutralized_z double, industry string, y_fwd double, sample_weight double")
    folds = panel.fold_assignments(p.select("date"), [panel.Fold(1, (D[0], D[3]), (D[4], D[5]), (D[6], D[7]))])
    roles = {"signal_features": ["a_neutralized_z"], "categorical_context": ["industry"], "continuous_context": [], "targets": ["y_fwd"], "keys": ["date", "stock_code"], "weights": ["sample_weight"]}
    plain = model.contract(roles, "y_fwd")
    bound = model.contract(roles, "y_fwd", model.neutralized_signals(plain))
    seen = []
    model.train_folds(p, folds, bound, "y_fwd", lambda **k: seen.append(k) or Recorder(**k), {"depth": 3})
    assert seen == [{"depth": 3, "monotone": {"a_neutralized_z": 1}}]
    with pytest.raises(ValueError, match="can't enforce"):
        model.train_folds(p, folds, bound, "y_fwd", model.spark_factory)
    told = model.constraint_summary(bound)
    assert told["enabled"] and told["constrained_features"] == ["a_neutralized_z"] and told["constraints_by_feature"] == {"a_neutralized_z": 1, "industry": 0}
    out = model.train_folds(p, folds, plain, "y_fwd", model.spark_factory, {"maxIter": 2, "maxDepth": 2})
    gains = {r.feature: r for r in out["importance"].collect()}
    assert gains["a_neutralized_z"].importance_split == sum((t.numNodes - 1) // 2 for t in out["models"][1].trees)
    model.save_models(spark, out["models"], plain, str(tmp_path / "m"))
    models, again = model.load_models(spark, str(tmp_path / "m"))
    assert again == plain and models[1].toDebugString == out["models"][1].toDebugString
    assert out["predictions"].count() == 4 * len(CODES)
    with pytest.raises(PySparkException, match="labels must be finite"):
        model.train_folds(p.withColumn("y_fwd", F.lit(None).cast("double")), folds, plain, "y_fwd", Recorder)


def test_extremes_are_classified(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    close = {d: 10.0 for d in days}
    close[days[20]] = 4.0
    rows = [(c, d, x, 1.0) for c in ("000001", "000002") for d, x in close.items() if c == "000001" or d >= days[18]]
    rows += [("000003", d, 10.0 if d < days[20] else 20.0, 60.0) for d in days if not days[10] <= d < days[20]]
    history = spark.createDataFrame(rows, "stock_code string, date date, close double, pct_change double")
    label = spark.createDataFrame([(days[18], c, 0.6) for c in ("000001", "000002", "000003", "000009")] + [(days[39] + dt.timedelta(days=9), "000001", -0.7), (days[0], "000001", 0.1)], "date date, stock_code string, value double")
    stocks = spark.createDataFrame([("000001", None, None)], "stock_code string, listing_date date, delist_date date")
    out = {(r.stock_code, r.label_date): r for r in quality.classify_extremes(quality.extreme_evidence(label, history, calendar, stocks)).collect()}
    assert out["000001", days[18]].primary_cause == "corporate_action_unadjusted_price_discontinuity"
    assert out["000002", days[18]].primary_cause == "new_listing_first_days"
    assert out["000003", days[18]].primary_cause == "resumption_after_short_suspension"
    assert out["000009", days[18]].primary_cause == "missing_local_daily_history"
    assert out["000001", days[39] + dt.timedelta(days=9)].primary_cause == "pre_listing_or_no_trading_record_on_label_date"
    assert len(out) == 5


def test_horizons(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    price = np.exp(np.cumsum(rng.normal(0, 0.05, 60)))
    closes = spark.createDataFrame([(d, "1", float(x)) for d, x in zip(days, price, strict=True)], "date date, stock_code string, close double")
    r = spark.createDataFrame([(days[k], "1", float(price[k + 3] / price[k] - 1)) for k in range(57)], "date date, stock_code string, value double")
    best = quality.best_horizon(quality.horizon_errors(r, closes, 6)).first()
    assert (best.horizon, best.n, best.within_basis) == (3, 57, 57)


# ---- sources and sinks


def test_tables_matrices_and_bundles(spark, tmp_path):
    df = spark.createDataFrame([(D[0], "000001", 0.5), (D[1], "000002", None)], "date date, stock_code string, value double")
    writers.write_csv(df, str(tmp_path / "t.csv"), one_file=True)
    back = readers.read_table(spark, str(tmp_path / "t.csv"), ["stock_code", "value"])
    assert {r.stock_code for r in back.collect()} == {"000001", "000002"}
    with pytest.raises(ValueError, match="can't read"):
        readers.read_table(spark, "x.pkl")
    (tmp_path / "m.csv").write_text("date,000001,000002\n2024-01-02,0.5,\n2024-01-03,,0.25\n")
    assert {tuple(r) for r in readers.read_matrix(spark, str(tmp_path / "m.csv")).select("date", "stock_code", "value").collect()} == {(D[0], "000001", 0.5), (D[1], "000002", 0.25)}
    manifest = bundles.write_bundle(spark, "daily_dataset", {"panel": df}, str(tmp_path / "bundle"), {"k": 1})
    assert manifest["tables"]["panel"]["rows"] == 2
    writers.write_dated(df, str(tmp_path / "dated"))
    assert spark.read.parquet(str(tmp_path / "dated/index")).count() == 2
    writers.zip_folder(tmp_path / "bundle", tmp_path / "b.zip")
    assert len(writers.sha256_of(tmp_path / "b.zip")) == 64


def test_dated_partitions_hold_their_own_date(spark, tmp_path):
    for d in D[:2]:
        (tmp_path / f"{d}.csv").write_text(f"symbol,trade_date,change\n1,{d},0.5\n2,{d},x\n")
    manifest = spark.createDataFrame([(str(d), f"{d}.csv") for d in D[:2]], "date string, file_path string")
    out = readers.read_dated(spark, manifest, str(tmp_path), start=str(D[1]), numeric=["change"])
    assert [(r.date, r.change) for r in out.orderBy("symbol").collect()] == [(D[1], 0.5), (D[1], None)]
    (tmp_path / f"{D[0]}.csv").write_text(f"symbol,trade_date,change\n1,{D[1]},0.5\n")
    with pytest.raises(PySparkException, match="another date"):
        readers.read_dated(spark, manifest, str(tmp_path)).collect()


def test_zipped_and_gbk_sources(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "daily.zip", "w") as z:
        z.writestr("000001.SZ.csv", "﻿交易日期,收盘价,成交额(千元)\n20240102,10,5\n20240103,11,x\n")
    out = readers.read_stock_histories(spark, str(tmp_path / "daily.zip")).orderBy("date").collect()
    assert [(r.stock_code, r.date, r.amount_k) for r in out] == [("000001", D[0], 5.0), ("000001", D[1], None)]
    assert out[1].close_return == pytest.approx(0.1)
    with zipfile.ZipFile(tmp_path / "20240103_index.zip", "w") as z:
        z.writestr("members.csv", "代码\n1.SZ\n600000.SH\n")
    assert {tuple(r) for r in readers.read_snapshots(spark, str(tmp_path / "20240103_index.zip"), "代码").collect()} == {(D[1], "000001"), (D[1], "600000")}
    (tmp_path / "industry.txt").write_bytes("000001\t银行\n".encode("gbk"))
    assert [tuple(r) for r in readers.read_gbk_table(spark, str(tmp_path / "industry.txt"), ["stock_code", "industry"]).collect()] == [("000001", "银行")]


def test_metadata_prefers_the_reference(spark):
    stocks = spark.createDataFrame([("1", "old", "主板", "SZ"), ("300001", "tech", None, None)], "stock_code string, industry string, market_type string, exchange string")
    industry = spark.createDataFrame([("000001", "bank")], "stock_code string, industry string")
    reference = readers.read_board_reference(spark.createDataFrame([("300001.SZ", "STAR", None), ("1", None, "主板")], "ts_code string, listing_board_code string, listing_board string").withColumn("exchange", F.lit("SH")))
    got = {r.stock_code: (r.industry, r.board, r.board_source) for r in readers.static_metadata(stocks, industry, reference).collect()}
    assert got == {"000001": ("bank", "SSE_MAIN", "listing_board_reference"), "300001": ("tech", "STAR", "listing_board_reference")}
    plain = {r.stock_code: r.board for r in readers.static_metadata(stocks, industry).collect()}
    assert plain == {"000001": "SZSE_MAIN", "300001": "CHINEXT"}


def test_the_training_query_trains_all_folds_with_the_default_model(spark, monkeypatch):
    from panelforge.plans import market, score_queries

    seen = []

    def train(built, folds, c, target, factory=model.default_factory, params=None, fold_ids=None):
        seen.append((sorted(r[0] for r in folds.select("fold_id").distinct().collect()), factory, c.monotone, fold_ids))
        return {"predictions": built}

    monkeypatch.setattr(model, "train_folds", train)
    score_queries.train_predict(spark, "/root/testdata/sf0.01")
    assert seen == [([f.fold_id for f in market.FOLDS], model.default_factory, {"alpha_neutralized_rank": 1, "alpha_neutralized_z": 1}, None)]
