"""Histogram trees and logistic regression against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import crossval, learners, logistic, trees
from panelloom.operators.boosting import OBJECTIVES, fit_boosted
from panelloom.operators.trees import BoostedTrees, TreeParams


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 500
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    y = np.where(a > 0.2, 1.5, -0.5) + 0.3 * b + 0.2 * c
    rows = []
    for i in range(n):
        rows.append((
            i, dt.date(2000 + i % 3, 1 + i % 12, 1), None if i % 7 == 0 else float(a[i]),
            float("nan") if i % 11 == 0 else float(b[i]), None if i % 50 == 3 else float(y[i]),
            float(min(max(int(y[i] + 0.5), 0), 2)),
        ))
    return spark.createDataFrame(rows, "id int, month date, a double, b double, y double, c double").cache()


def plain(table, label="y"):
    rows = table.where(F.col(label).isNotNull()).orderBy("id").collect()
    x = np.array([[np.nan if r["a"] is None else r["a"], r["b"]] for r in rows], float)
    return x, np.array([r[label] for r in rows], float)


def brute_tree(x, g, h, cuts, params, depth, node=0):
    """{node: (factor, cut, missing_left)} of inner nodes and {node: step} of leaves, by trying all cuts."""
    lam = params.reg_lambda
    best = (trees.LEAST_GAIN, None)
    total = g.sum() ** 2 / (h.sum() + lam)
    if depth:
        for f in range(x.shape[1]):
            for side in (False, True):
                for cut in [*cuts[f], *([] if side else [np.inf])]:
                    left = np.where(np.isnan(x[:, f]), side, x[:, f] <= cut)
                    if not 0 < left.sum() < len(g):
                        continue
                    if min(h[left].sum(), h[~left].sum()) < params.min_child_weight:
                        continue
                    gain = sum(g[m].sum() ** 2 / (h[m].sum() + lam) for m in (left, ~left)) - total
                    if gain > best[0] * (1 + 1e-9) and gain >= params.gamma:
                        best = (gain, (f, cut, side, left))
    if best[1] is None:
        return {}, {node: -params.eta * g.sum() / (h.sum() + lam)}
    f, cut, side, left = best[1]
    inner, leaves = {node: (f, cut, side)}, {}
    for m, child in ((left, 2 * node + 1), (~left, 2 * node + 2)):
        more = brute_tree(x[m], g[m], h[m], cuts, params, depth - 1, child)
        inner |= more[0]
        leaves |= more[1]
    return inner, leaves


@pytest.mark.parametrize("settings", [
    {}, {"reg_lambda": 0.0, "min_child_weight": 40.0}, {"gamma": 20.0}, {"max_depth": 5, "max_bins": 200}, {"max_bins": 2},
])
def test_first_tree_equals_trying_all_cuts(table, settings):
    params = TreeParams(rounds=1, **{"max_depth": 3, "max_bins": 16, **settings})
    model = BoostedTrees(["a", "b"], "y", params).fit(table)
    x, y = plain(table)
    cuts = [np.unique(np.quantile(c[~np.isnan(c)], np.arange(1, params.max_bins) / params.max_bins)) for c in x.T]
    inner, leaves = brute_tree(x, -y, np.ones(len(y)), cuts, params, params.max_depth)
    tree = model.trees[0][0]
    got = {i: (int(f), tree.cut[i], bool(tree.missing_left[i])) for i, f in enumerate(tree.feature) if f >= 0}
    assert got.keys() == inner.keys()
    for i, (f, cut, side) in inner.items():
        assert got[i] == (f, pytest.approx(cut), side)
    for i, value in leaves.items():
        assert tree.value[i] == pytest.approx(value)


@pytest.mark.parametrize("objective", OBJECTIVES)
def test_loss_falls_in_every_round(table, objective):
    shifted = table.withColumn("y", F.col("y") + 3) if objective == "squared_log" else table
    model = fit_boosted(shifted, ["a", "b"], "y", objective, rounds=4, eta=0.5, max_depth=2, max_bins=16)
    x, y = plain(shifted)
    losses = []
    for r in range(5):
        part = trees.TreeModel(model.features, model.params, model.trees[:r])
        losses.append(trees.row_losses(objective, y, part.raw(x)).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    if objective != "mse":
        assert losses[1:] == pytest.approx(model.losses)


@pytest.mark.parametrize("objective", ["mape", "log_abs"])
def test_leaves_are_weighted_medians(table, objective):
    model = fit_boosted(table, ["a", "b"], "y", objective, rounds=1, eta=1.0, max_depth=2, max_bins=8)
    x, y = plain(table)
    tree = model.trees[0][0]
    leaf = tree.walk(x, np.isnan, tree.cut)
    weight = trees.residual_weight(objective, y, 0.0 - y)
    for i in np.unique(leaf):
        own = leaf == i
        order = np.argsort(y[own])
        upto = np.cumsum(weight[own][order])
        assert tree.value[i] == pytest.approx(y[own][order][np.searchsorted(upto, upto[-1] / 2)])


def test_radix_order_is_that_of_the_numbers():
    x = np.array([-np.inf, -1e300, -2.0, -1e-320, -0.0, 0.0, 1e-320, 1.0, 3.5, np.inf])
    bits = trees.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert [trees.from_bits(int(b)) for b in bits] == x.tolist()


def test_kept_scores_change_nothing(table, monkeypatch):
    params = TreeParams(rounds=5, max_depth=2, max_bins=8, subsample=0.7, eta=0.4)
    whole = BoostedTrees(["a", "b"], "y", params).fit(table)
    monkeypatch.setattr(trees, "ROUNDS_KEPT", 2)
    monkeypatch.setattr(trees, "CELLS", 1)
    again = BoostedTrees(["a", "b"], "y", params).fit(table)
    assert [r[:4] + r[5:6] for r in whole.rows()] == [r[:4] + r[5:6] for r in again.rows()]
    x, _ = plain(table)
    assert whole.raw(x) == pytest.approx(again.raw(x))


def test_softmax_and_logistic_trees(table):
    settings = {"n_estimators": 6, "max_depth": 3, "max_bins": 32}
    many = learners.boosted_classifier(["a", "b"], "c", 3, **settings).fit(table)
    out = many.transform(table)
    assert out.where("abs(aggregate(probability, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0
    assert out.where("pred = c").count() > 350
    two = table.withColumn("c", (F.col("c") > 1).cast("double"))
    found = learners.boosted_trees(["a", "b"], "c", "logistic", **settings).fit(two).transform(two)
    assert found.where("pred = c").count() > 400
    assert found.where("pred <> CAST(probability[1] > 0.5 AS DOUBLE)").count() == 0


def test_every_row_is_scored_and_stored_models_score_alike(spark, table, tmp_path):
    model = learners.boosted_trees(["a", "b"], "y", n_estimators=3, max_depth=2).fit(table)
    learners.save_model(model, str(tmp_path / "m"))
    loaded = learners.load_model(str(tmp_path / "m"))
    a = {r.id: r.pred for r in model.transform(table).collect()}
    assert len(a) == 500 and None not in a.values()
    assert a == {r.id: r.pred for r in loaded.transform(table).collect()}
    ridge = learners.linear_regression(["a", "b"], "y").fit(table)
    learners.save_model(ridge, str(tmp_path / "r"))
    for fitted in (ridge, learners.load_model(str(tmp_path / "r"))):
        out = fitted.transform(table)
        assert out.count() == 500
        assert out.where("pred IS NULL AND a IS NOT NULL AND NOT isnan(b)").count() == 0
        assert out.where("pred IS NOT NULL AND (a IS NULL OR isnan(b))").count() == 0


def test_nothing_to_learn(spark, table):
    none = table.where("id < 0")
    model = learners.boosted_trees(["a", "b"], "y", n_estimators=2).fit(none)
    assert {r.pred for r in model.transform(table).collect()} == {0.0}
    flat = learners.boosted_trees(["a"], "y", n_estimators=1, eta=1.0, reg_lambda=0.0).fit(table.withColumn("a", F.lit(None).cast("double")))
    assert flat.transform(table).first().pred == pytest.approx(table.agg(F.avg("y")).first()[0])


def make(name):
    if name == "trees":
        return learners.boosted_trees(["a", "b"], "y", n_estimators=2, max_depth=2, max_bins=8, key=["id"])
    return learners.logistic(["a", "b"], "c", 3, c=0.5)


@pytest.mark.parametrize("name", ["trees", "logistic"])
def test_walk_forward_equals_a_fit_per_month(table, name):
    begin = F.lit("2002-01-01").cast("date")
    train, test = table.where(F.col("month") < begin), table.where(F.col("month") >= begin)
    side, walked = learners.predict(make(name), train, test, ["id"], "month", expand_window=True)
    got = {r.id: r.pred for r in walked.collect()}
    assert len(got) == test.count()
    cuts = F.col("_part") == 0
    for month in [dt.date(2002, m, 1) for m in (3, 7, 12)]:
        grown = train.withColumn("_part", F.lit(0)).unionByName(
            test.where(F.col("month") < F.lit(month)).withColumn("_part", F.lit(1)))
        if name == "trees":
            fitted = trees.fit_together(grown, [make(name)], [None], cuts_from=cuts)[0]
        else:
            fitted = make(name).fit(grown)
        for r in fitted.transform(test.where(F.col("month") == F.lit(month))).collect():
            assert got[r.id] == (pytest.approx(r.pred) if r.pred is not None else None)
    assert side.count() == train.count() + test.where(F.col("month") < F.lit(dt.date(2002, 12, 1))).count()


def test_search_of_trees_equals_single_fits(spark, table):
    labelled = table.where("y IS NOT NULL")
    folds = [(dt.date(2000, 1, 1), dt.date(2000, 12, 1)), (dt.date(2001, 1, 1), dt.date(2002, 12, 1))]
    rule = (2, 1, True)

    def build(p):
        return learners.boosted_trees(["a", "b"], "y", n_estimators=2, max_bins=8, **p)

    sets = [{"max_depth": 1}, {"max_depth": 3, "eta": 0.5}]
    long = crossval.estimator_cv(labelled, "month", ["id"], "y", build, sets, folds, "reg", *rule)
    got = {(r.model_id, r.fold, r.partition): r.value for r in long.where("metric = 'mse'").collect()}
    cuts = trees.quantile_cuts(labelled, ["a", "b"], 8)
    for i, p in enumerate(sets):
        for f, fold in enumerate(folds):
            train, val = crossval.fold_frames(labelled, "month", fold, rule)
            data = trees.bin_panel(train, ["a", "b"], "y", 8, cuts=cuts)
            model = trees.fit_jobs(data, [trees.Job(build(p).params)])[0]
            for name, part in (("train", train), ("val", val)):
                mse = model.transform(part).agg(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2.0)))).first()[0]
                assert got[i, f, name] == pytest.approx(-mse)


# ---- logistic regression -------------------------------------------------------------------------


def whole(table):
    x, y = plain(table, "c")
    keep = ~np.isnan(x).any(axis=1)
    return np.column_stack([np.ones(keep.sum()), x[keep]]), y[keep]


@pytest.mark.parametrize("scheme", ["multinomial", "ovr"])
@pytest.mark.parametrize("c", [None, 1.0, 0.01])
def test_logistic_solves_its_equations(table, scheme, c):
    model = logistic.Logistic(["a", "b"], "c", c=c, scheme=scheme).fit(table)
    x, y = whole(table)
    w = model.weights
    assert w.shape == (3, 3)
    margins = x @ w.T
    if scheme == "ovr":
        p = 1 / (1 + np.exp(-margins))
    else:
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    slope = (p - (y[:, None] == np.arange(3))).T @ x
    if c is not None:
        slope[:, 1:] += w[:, 1:] / c
    assert np.abs(slope).max() < 1e-5
    if scheme == "multinomial":
        assert w.sum(axis=0) == pytest.approx(np.zeros(3), abs=1e-6)


def test_logistic_scores_every_row(table):
    out = learners.logistic(["a", "b"], "c", 3).fit(table).transform(table)
    assert out.count() == 500
    missing = F.col("a").isNull() | F.isnan("b")
    assert out.where(missing & (F.col("pred").isNotNull() | F.col("probability").isNotNull())).count() == 0
    assert out.where(~missing & F.col("pred").isNull()).count() == 0
    assert out.where("pred = c").count() > 250
    assert out.where("abs(aggregate(probability, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0


def test_penalties_and_folds_in_one_fit(table):
    days = [frozenset(range(10957, 11323)), None]
    made = [logistic.Logistic(["a", "b"], "c", 3, c=c, scheme="ovr") for c in (0.1, 5.0)]
    both = logistic.fit_together(table, made, days, F.unix_date("month"))
    first = made[0].fit(table.where("month <= '2000-12-31'"))
    assert both[0].weights == pytest.approx(first.weights)
    assert both[1].weights == pytest.approx(made[1].fit(table).weights)


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, c double")
    model = logistic.Logistic(["x"], "c", max_iter=15).fit(df)
    assert np.isfinite(model.weights).all() and model.transform(df).where("pred = c").count() == 12
    assert math.isfinite(model.weights[1, 1])
