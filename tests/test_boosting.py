"""Boosted trees against a plain tree grower, and what Huber loss, constraints, categories and early stopping promise."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelforge.operators import boosting, model, panel
from panelforge.operators.boosting import Booster, BoostedTrees, Settings

FULL = {"subsample": 1.0, "colsample_bytree": 1.0, "n_estimators": 3, "learning_rate": 0.3, "min_child_samples": 5, "max_depth": 3, "num_leaves": 6}


def frame(spark, x, y, w=None, valid=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    valid = np.zeros(len(y), bool) if valid is None else valid
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), float(a), float(b), bool(v)) for r, a, b, v in zip(x, y, w, valid, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "label", "weight"]) + ", is_valid boolean").repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df), names


def made(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    return x, np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) + 0.1 * rng.normal(size=n), rng.uniform(0.5, 2, n)


def grow(x, y, w, s, signs, trees):
    """Leaf by leaf, over all values of all features, with sums over rows; predictions of the train rows."""
    score = np.full(len(y), (w * y).sum() / w.sum())
    for _ in range(trees):
        g, h = np.clip(score - y, -s.alpha, s.alpha) * w, w
        out = lambda rows, lo, hi: min(max(-g[rows].sum() / (h[rows].sum() + s.reg_lambda), lo), hi)
        gain = lambda rows, o: -(2 * g[rows].sum() * o + (h[rows].sum() + s.reg_lambda) * o * o)

        def best(rows, lo, hi):
            found = None
            for f in range(x.shape[1]):
                for v in sorted(set(x[rows, f]))[:-1]:
                    a, b = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if min(len(a), len(b)) < s.min_child_samples:
                        continue
                    oa, ob = out(a, lo, hi), out(b, lo, hi)
                    won = gain(a, oa) + gain(b, ob) - gain(rows, out(rows, lo, hi))
                    if won > 1e-9 and signs[f] * (ob - oa) >= 0 and (found is None or won > found[0] * (1 + 1e-12)):
                        found = (won, f, a, b, oa, ob)
            return found

        leaves = {1: (np.arange(len(y)), -math.inf, math.inf, 0.0)}
        while len(leaves) < s.num_leaves:
            options = [(b[0], n, b) for n, (rows, lo, hi, _) in leaves.items() if n.bit_length() <= s.max_depth and (b := best(rows, lo, hi))]
            if not options:
                break
            _, n, (_, f, a, b, oa, ob) = max(options, key=lambda o: (o[0], -o[1]))
            rows, lo, hi, _ = leaves.pop(n)
            middle = (oa + ob) / 2
            sides = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[signs[f]]
            leaves[2 * n], leaves[2 * n + 1] = (a, *sides[0], oa), (b, *sides[1], ob)
        for rows, _, _, o in leaves.values():
            score[rows] += s.learning_rate * o
    return score


@pytest.mark.parametrize("signs", [(0, 0, 0), (1, 0, -1)])
def test_trees_equal_a_plain_grower(spark, signs):
    x, y, w = made()
    df, names = frame(spark, x, y, w)
    trained = Booster({n: s for n, s in zip(names, signs, strict=True) if s}, **FULL).named(names, {}).fit(df)
    want = grow(x, y, w, Settings(**FULL), signs, 3)
    assert len(trained.trees) == 3
    np.testing.assert_allclose(trained.predict(x), want, atol=1e-7)
    got = {tuple(r.features.toArray()): r.prediction for r in trained.transform(df).collect()}
    np.testing.assert_allclose([got[tuple(r)] for r in x], trained.predict(x), atol=1e-12)


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_partitions_and_order_do_not_change_the_model(spark, share):
    x, y, w = made()
    args = FULL | {"subsample": share, "colsample_bytree": 0.7, "n_estimators": 4}
    a, b = (Booster(**args).fit(frame(spark, x[o], y[o], w[o], parts=p)[0]) for p, o in ((1, slice(None)), (5, slice(None, None, -1))))
    np.testing.assert_allclose(a.predict(x), b.predict(x), atol=1e-9)
    assert [t.rows for t in a.trees] == [t.rows for t in b.trees]
    shares = [boosting.drawn(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64), 42, k, 0.6).mean() for k in range(5)]
    assert all(abs(s - 0.6) < 0.02 for s in shares) and len(set(shares)) > 1


def test_huber_loss_resists_an_outlier(spark):
    x, y, w = made(300)
    wild = y.copy()
    wild[7] = 1e4
    args = FULL | {"n_estimators": 8}
    moved = {}
    for loss in ("huber", "squared"):
        clean, spoilt = (Booster(objective=loss, **args).fit(frame(spark, x, t, w)[0]) for t in (y, wild))
        at = np.arange(len(y)) != 7
        # the first score is the mean in both; what the trees add is compared
        moved[loss] = np.abs((spoilt.predict(x) - spoilt.init) - (clean.predict(x) - clean.init))[at].mean()
    assert moved["huber"] < 6 and moved["squared"] > 10 * moved["huber"]


def test_predictions_never_fall_along_a_constrained_feature(spark):
    x, y, w = made(400, 3)
    df, names = frame(spark, x, y, w)
    args = FULL | {"n_estimators": 15, "max_depth": 4, "num_leaves": 12}
    free, bound = (Booster(m, **args).named(names, {}).fit(df) for m in (None, {"f0": 1, "f1": -1}))
    grid = np.linspace(-3, 3, 61)
    falls = {"free": 0, "bound": 0}
    for a, b in itertools.product((-1.0, 0.0, 1.0), repeat=2):
        for f, sign in ((0, 1), (1, -1)):
            rest = [k for k in range(3) if k != f]
            points = np.empty((len(grid), 3))
            points[:, f], points[:, rest[0]], points[:, rest[1]] = grid, a, b
            for name, trained in (("free", free), ("bound", bound)):
                falls[name] += int((sign * np.diff(trained.predict(points)) < -1e-12).sum())
    assert falls["bound"] == 0 < falls["free"]
    assert bound.gain_by_feature()["f1"] >= 0 and sum(bound.splits_by_feature().values()) == sum(len(t.gains) for t in bound.trees)
    with pytest.raises(ValueError, match="numeric"):
        Booster({"f0": 1}).named(names, {"f0": 4})
    with pytest.raises(ValueError, match="numeric"):
        Booster({"other": 1}).named(names, {})


def test_category_splits_equal_the_best_of_all_subsets(spark):
    rng = np.random.default_rng(4)
    for levels in (3, 5):
        cat, w = rng.integers(0, levels, 300), rng.uniform(0.5, 2, 300)
        y = rng.normal(size=levels)[cat] + 0.3 * rng.normal(size=300)
        s = Settings(**FULL | {"reg_lambda": 0.0, "cat_l2": 0.0, "cat_smooth": 0.0})
        df, names = frame(spark, cat[:, None].astype(float), y, w)
        trained = Booster(**FULL | {"reg_lambda": 0.0, "cat_l2": 0.0, "cat_smooth": 0.0}).named(names, {"f0": levels}).fit(df)
        g = np.clip((w * y).sum() / w.sum() - y, -s.alpha, s.alpha) * w
        part = lambda rows: g[rows].sum() ** 2 / w[rows].sum()
        best = max(part(np.isin(cat, some)) + part(~np.isin(cat, some)) - part(np.ones(300, bool)) for k in range(1, levels) for some in itertools.combinations(range(levels), k))
        assert trained.trees[0].gains[1] == pytest.approx(best, rel=1e-9)
        again = BoostedTrees.read(trained.told())
        codes = np.arange(levels + 3, dtype=float)[:, None]  # codes that were not seen count as the last
        np.testing.assert_array_equal(again.predict(codes), trained.predict(np.minimum(codes, levels - 1)))


def test_categories_are_smoothed(spark):
    # nine rows of a strong category are too few for cat_smooth = 10
    cat = np.array([0] * 9 + [1] * 100 + [2] * 100)
    y = np.where(cat == 0, 0.8, np.where(cat == 1, 0.1, -0.1)) + 0.01 * np.arange(209) / 209
    df, names = frame(spark, cat[:, None].astype(float), y)
    for smooth, left in ((10.0, False), (1.0, True)):
        first = Booster(**FULL | {"cat_smooth": smooth, "cat_l2": 0.0}).named(names, {"f0": 3}).fit(df).trees[0]
        assert bool(first.left[1][0]) is left  # what is not put in order goes right


def test_early_stopping_keeps_the_best_round(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 3)), rng.normal(size=400)  # nothing to learn: the valid loss soon rises
    y[:300] += 0.2 * x[:300, 0]
    valid = np.arange(400) >= 300
    df, _ = frame(spark, x, y, None, valid)
    trained = Booster(**FULL | {"n_estimators": 40, "patience": 4}).fit(df)
    assert len(trained.all_trees) == trained.best_iteration + 4 < 40 and len(trained.trees) == trained.best_iteration >= 1
    losses = trained.losses
    assert losses.index(min(losses[1:]), 1) == trained.best_iteration
    s = trained.settings
    for n in (0, 1, trained.best_iteration):
        part = BoostedTrees(trained.names, trained.bins, trained.init, trained.all_trees, n, s)
        assert s.losses(part.predict(x[valid]) - y[valid]).mean() == pytest.approx(losses[n], rel=1e-7)
    whole = Booster(**FULL | {"n_estimators": 6, "patience": 0}).fit(df)
    assert whole.best_iteration == len(whole.all_trees) == 6 and len(whole.losses) == 7


def test_sampling_is_repeatable_and_scores_survive_their_cut(spark, monkeypatch):
    x, y, w = made()
    df, _ = frame(spark, x, y, w, parts=2)
    args = FULL | {"subsample": 0.7, "colsample_bytree": 0.5, "n_estimators": 7}
    plain = Booster(**args).fit(df)
    monkeypatch.setattr(boosting, "CUT", 2)
    cut = Booster(**args).fit(df)
    assert plain.told() == cut.told()
    assert {len({int(t.feature[n]) for n in t.gains}) <= 2 for t in plain.trees} == {True}  # of three features, two a tree
    assert any(sum(t.rows.values()) < 240 for t in plain.trees)


def test_constant_labels_few_rows_and_wrong_parameters(spark):
    x, y, w = made(50)
    flat = Booster(**FULL).fit(frame(spark, x, np.ones(50), w)[0])
    assert flat.trees == [] and (flat.predict(x) == flat.init).all() and flat.init == pytest.approx(1)
    few = Booster().fit(frame(spark, x, y, w)[0])  # 500 rows a child by default: nothing splits
    assert all(t.gains == {} for t in few.trees) and len(few.trees) < boosting.IDLE and (few.predict(x) == few.init).all()
    with pytest.raises(ValueError, match="no train rows"):
        Booster(**FULL).fit(frame(spark, x, y, w, np.ones(50, bool))[0])
    for bad in ({"objective": "l1"}, {"max_depth": 0}, {"num_leaves": 1}, {"subsample": 0}, {"unknown": 1}):
        with pytest.raises(ValueError):
            Booster(**bad)


# ---- folds

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]


def panel_rows(spark, days=D, n=40):
    rng = np.random.default_rng(9)
    rows = [(d, f"{k:06d}", float(s := rng.normal()), "ab c"[k % 4], 0.5 * s + 0.1 * float(rng.normal()), 1.0 + k % 3) for d in days for k in range(n)]
    return spark.createDataFrame(rows, "date date, stock_code string, a_neutralized_z double, industry string, y_fwd double, sample_weight double")


ROLES = {"signal_features": ["a_neutralized_z"], "categorical_context": ["industry"], "continuous_context": [], "targets": ["y_fwd"], "keys": ["date", "stock_code"], "weights": ["sample_weight"]}
FOLDS = [panel.Fold(1, (D[0], D[3]), (D[4], D[5]), (D[6], D[7])), panel.Fold(2, (D[0], D[5]), (D[6], D[7]), (D[8], D[9]))]
SMALL = {"n_estimators": 6, "min_child_samples": 10, "learning_rate": 0.2, "patience": 3}


def test_folds_are_trained_with_neutralised_signals_held_monotone(spark, tmp_path):
    p = panel_rows(spark)
    # rows outside all folds may lack anything
    p = p.unionByName(p.limit(1).withColumns({"date": F.lit(D[11]), "y_fwd": F.lit(None).cast("double"), "sample_weight": F.lit(-1.0), "a_neutralized_z": F.lit(float("nan"))}))
    folds = panel.fold_assignments(p.select("date"), FOLDS)
    plain = model.contract(ROLES, "y_fwd")
    c = model.contract(ROLES, "y_fwd", model.neutralized_signals(plain))
    out = model.train_folds(p, folds, c, "y_fwd", params=SMALL, predicted=("train", "valid", "test"))
    got = out["predictions"].collect()
    assert {(r.fold_id, r.split) for r in got} == {(f, s) for f in (1, 2) for s in ("train", "valid", "test")}
    assert sum(r.fold_id == 1 and r.split == "train" for r in got) == 160
    told = {(r.fold_id, r.split): r for r in out["folds"].collect()}
    assert told[1, "train"].row_count == 160 and told[2, "valid"].date_count == 2 and told[2, "test"].end_date == D[9]
    for fold, m in out["models"].items():
        assert m.best_iteration == told[fold, "test"].best_iteration == len(m.trees)
        points = np.array([[v, k] for k in range(5) for v in np.linspace(-3, 3, 41)])
        for k in range(5):
            assert (np.diff(m.predict(points[points[:, 1] == k])) >= 0).all()
    gains = {(r.fold_id, r.feature): r for r in out["importance"].collect()}
    assert gains[1, "a_neutralized_z"].importance_gain > 0 and gains[1, "a_neutralized_z"].importance_split >= 1
    model.save_models(spark, out["models"], c, str(tmp_path / "m"))
    models, again = model.load_models(spark, str(tmp_path / "m"))
    assert again == c and {f: m.told() for f, m in models.items()} == {f: m.told() for f, m in out["models"].items()}
    diagnostics = model.summarize_tree_diagnostics({f: model.tree_diagnostics(m) for f, m in models.items()})
    assert diagnostics["tree_count"] == sum(len(m.trees) for m in models.values()) and 1 <= diagnostics["max_depth"] <= 5


def test_broken_rows_inside_a_fold_stop_the_training(spark):
    p = panel_rows(spark)
    folds = panel.fold_assignments(p.select("date"), FOLDS[:1])
    c = model.contract(ROLES, "y_fwd")
    hit = (F.col("date") == D[4]) & (F.col("stock_code") == "000001")
    for column, value, said in (("y_fwd", None, "labels must be finite"), ("sample_weight", -1.0, "sample weights"), ("a_neutralized_z", float("inf"), "model features")):
        broken = p.withColumn(column, F.when(hit, F.lit(value).cast("double")).otherwise(F.col(column)))
        with pytest.raises(PySparkException, match=said):
            model.train_folds(broken, folds, c, "y_fwd", params=SMALL)
    with pytest.raises(ValueError, match="no rows with a weight in \\['valid'\\]"):
        model.train_folds(p.withColumn("sample_weight", F.when(F.col("date").isin(D[4], D[5]), 0.0).otherwise(1.0)), folds, c, "y_fwd", params=SMALL)


def test_a_panel_without_folds_gives_empty_tables(spark):
    p = panel_rows(spark)
    folds = panel.fold_assignments(p.select("date"), FOLDS[:1])
    got = model.train_folds(p.limit(0), folds.limit(0), model.contract(ROLES, "y_fwd"), "y_fwd", params=SMALL)
    whole = model.train_folds(p, folds, model.contract(ROLES, "y_fwd"), "y_fwd", params=SMALL | {"n_estimators": 1})
    for name in ("predictions", "importance", "folds"):
        assert got[name].count() == 0 and got[name].columns == whole[name].columns
    assert got["models"] == {}


def test_only_known_models_are_loaded(spark, tmp_path):
    told = '{"contract": {"signals": ["a"], "categories": [], "numbers": [], "monotone": {}}, "folds": {"1": "os.path.join"}}'
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(str(tmp_path / "m/contract"))
    with pytest.raises(ValueError, match="os.path.join"):
        model.load_models(spark, str(tmp_path / "m"))
    models, _ = model.load_models(spark, str(tmp_path / "m"), lambda name, path: (name, path))
    assert models[1] == ("os.path.join", str(tmp_path / "m/fold_id=1"))


def test_root_gains_hold_the_first_split(spark):
    x, y, w = made()
    cat = np.random.default_rng(2).integers(0, 4, len(y))
    df, names = frame(spark, np.column_stack([x, cat]), y + 0.4 * cat, w)
    args = FULL | {"n_estimators": 1, "cat_smooth": 2.0}
    gains = boosting.root_gains(df, names, F.col("label"), F.col("weight"), {"f3": 4}, **args).collect()
    first = Booster(**args).named(names, {"f3": 4}).fit(df).trees[0]
    best = max(gains, key=lambda r: r.gain)
    assert best.feature == names[first.feature[1]] and best.gain == pytest.approx(first.gains[1], rel=1e-9)
