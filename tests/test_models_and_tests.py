"""Scores, linear models, neighbours, boosting and significance tests."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import distributions, scalars
from panelloom.operators import crossval, learners, linear, metrics, selection
from panelloom.operators.boosting import fit_boosted
from panelloom.operators.neighbors import knn_predict, nearest_neighbors


def test_classifier_scores(spark):
    rows = list(zip([0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0]))
    df = spark.createDataFrame(rows, "y int, pred int")
    row = metrics.evaluate_classifier(df, "y").first()
    assert row.accuracy == pytest.approx(4 / 6)
    assert row.macro_f1 == pytest.approx(0.655556, abs=1e-6)
    f1 = {r.cls: r.f1 for r in metrics.class_report(df, "y").collect()}
    assert f1 == {"0": pytest.approx(0.5), "1": pytest.approx(0.8), "2": pytest.approx(2 / 3)}


def test_regressor_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (4.0, 2.0)], "y double, pred double")
    row = metrics.evaluate_regressor(df, "y").first()
    assert tuple(row) == pytest.approx((-0.0714286, -5 / 3, -1, -33.333333, -0.767528), abs=1e-6)


def study(spark, groups):
    rows = [(i, f, float(v)) for i, g in enumerate(groups) for f, v in enumerate(g)]
    return spark.createDataFrame(rows, "model_id int, fold int, value double").select(
        "model_id", F.lit(0).alias("epoch"), "fold", "value", F.lit("r2").alias("metric")
    )


def test_anova(spark):
    row = selection.anova(study(spark, [(1, 2, 3), (2, 3, 4), (5, 6, 7)]), ["metric"]).first()
    assert (row.f_stat, row.df_between, row.df_within) == (13.0, 2, 6)
    assert row.p_value == pytest.approx(0.006592, abs=1e-6)


def test_t_test(spark):
    row = selection.t_test(study(spark, [(1, 2, 3), (2, 3, 4)]), ["metric"], 0.05).first()
    assert row.t_stat == pytest.approx(-1.224745, abs=1e-6)
    assert row.p_value == pytest.approx(0.287864, abs=1e-6)
    assert not row.reject


def test_studentized_range():
    # From standard tables: 5 % critical values.
    for q, k, df in ((4.339, 3, 6), (3.877, 3, 10), (4.232, 5, 20), (2.829, 2, 60)):
        assert distributions.studentized_range_tail(q, k, df) == pytest.approx(0.05, abs=3e-4)
    assert distributions.studentized_range_critical(0.05, 3, 6) == pytest.approx(4.339, abs=1e-3)
    # Two groups: the range test is the t-test.
    t = 2.3
    assert distributions.studentized_range_tail(t * math.sqrt(2), 2, 9) == pytest.approx(
        distributions.t_tail(t, 9), abs=1e-8
    )


def test_tukey_and_selection(spark):
    long = study(spark, [(1, 2, 3), (5.2, 6.1, 7.0), (5, 6, 7.5)])
    pairs = {(r.group1, r.group2): r for r in selection.tukey(long, ["metric"], 0.05).collect()}
    assert pairs[0, 1].reject and pairs[0, 2].reject and not pairs[1, 2].reject
    assert pairs[1, 2].lower < pairs[1, 2].meandiff < pairs[1, 2].upper
    row = selection.select_best_model(long, [], ["r2"], 0.05).first()
    # Model 2 is best; model 1 does not differ from it and is preferred.
    assert (row.metric, row.id_best, row.id_selected) == ("r2", 2, 1)


@pytest.mark.parametrize("how", [None, "p", "f", "corr", "combined"])
def test_selection_rules(spark, how):
    good = study(spark, [(1, 2, 3), (5, 6, 7), (9, 10, 11)])
    combined = good.withColumn("metric", F.lit("combined_zscore"))
    strategy = good.withColumn("metric", F.lit("Top-Bottom"))
    noise = study(spark, [(1, 2, 3), (1, 2, 3), (1, 2, 3)]).withColumn("metric", F.lit("mae"))
    long = good.unionByName(noise).unionByName(combined).unionByName(strategy)
    row = selection.select_best_model(long, [], ["mae", "r2"], 0.05, how).first()
    assert row.metric == ("combined_zscore" if how == "combined" else "r2")
    assert row.id_selected == 2


def test_selection_falls_back_to_the_first_model(spark):
    row = selection.select_best_model(study(spark, [(1, 2, 3), (1, 2, 3.1), (1, 2, 2.9)]), [], ["r2"], 0.05).first()
    assert row.id_selected == 0 and row.metric is None


def test_combined_metric(spark):
    a = study(spark, [(1, 2), (3, 4)]).withColumn("partition", F.lit("val"))
    b = a.withColumn("metric", F.lit("mae")).withColumn("value", F.col("value") * 10 + 1)
    out = crossval.combined_metric(a.unionByName(b), ["r2", "mae"]).orderBy("model_id", "fold")
    z = (np.arange(1, 5) - 2.5) / np.std(np.arange(1, 5), ddof=1)
    assert [r.value for r in out.collect()] == pytest.approx(list(z))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i, f"2000-{i % 12 + 1:02d}-01", *map(float, rng.normal(size=3))) for i in range(600)
    ]
    df = spark.createDataFrame(rows, "sec int, month string, x1 double, x2 double, e double")
    y = 0.5 * F.col("x1") - 0.2 * F.col("x2") + 0.1 * F.col("e")
    return df.withColumn("month", F.to_date("month")).withColumn("y", y).cache()


@pytest.mark.parametrize("features", [["x1"], ["x1", "x2"], ["x1", "x2", "e"]])
@pytest.mark.parametrize("intercept", [True, False])
def test_ridge_matches_the_normal_equations(points, features, intercept):
    pdf = points.toPandas()
    x, y = pdf[features].to_numpy(), pdf["y"].to_numpy()
    mx, my = (x.mean(0), y.mean()) if intercept else (0 * x[0], 0.0)
    xc, yc = x - mx, y - my
    beta = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(len(features)), xc.T @ yc)
    row = linear.fit_ridge(points, features, "y", 3.0, intercept).first()
    assert [row[f"coef_{i}"] for i in range(len(features))] == pytest.approx(list(beta))
    assert row.intercept == pytest.approx(my - float(np.sum(mx * beta)))


def test_ridge_matches_spark_ml(points):
    ours = linear.predict_linear(points, linear.fit_ridge(points, ["x1", "x2"], "y", 5.0), ["x1", "x2"])
    size = points.agg(F.count("y"), F.stddev_pop("y")).first()
    model = learners.linear_regression(["x1", "x2"], "y", 5.0, size[0], size[1]).fit(points)
    theirs = model.transform(points).select("sec", F.col("pred").alias("other"))
    gap = ours.join(theirs, "sec").agg(F.max(F.abs(F.col("pred") - F.col("other")))).first()[0]
    assert gap < 1e-6


def test_walk_forward_equals_a_loop_of_fits(points):
    out = linear.walk_forward(points, "month", ["x1", "x2"], "y", "2000-10-01", "2000-12-01", 1.0)
    slow = learners.predict(
        _Ridge(), points.where("month < '2000-10-01'"), points.where("month >= '2000-10-01'"),
        ["sec", "month"], "month", expand_window=True,
    )[1]
    joined = out.join(slow.withColumnRenamed("pred", "other"), ["sec", "month"])
    assert joined.count() == 150
    assert joined.where("abs(pred - other) > 1e-9").count() == 0


class _Ridge:
    """A user's own model: fit and transform are all that is asked for."""

    def fit(self, df):
        coefs = linear.fit_ridge(df, ["x1", "x2"], "y", 1.0)
        self.transform = lambda d: linear.predict_linear(d, coefs, ["x1", "x2"])
        return self


def test_hc3_against_numpy(points):
    pdf = points.where("month = '2000-03-01'").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["x1"]])
    inv = np.linalg.inv(x.T @ x)
    y = pdf["y"].to_numpy()
    e = y - x @ (inv @ x.T @ y)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    row = linear.panel_regression(points, "month", "x1", "y").where("month = '2000-03-01'").first()
    assert (row.intercept_se, row.slope_se) == pytest.approx(tuple(np.sqrt(np.diag(cov))))


def brute_force(train, queries, k):
    out = {}
    for key, a, b in queries:
        near = sorted((math.hypot(a - x, b - y), t, v) for t, x, y, v in train)[:k]
        out[key] = [v for _, _, v in near]
    return out


@pytest.mark.parametrize("kind", ["uniform", "clustered", "duplicates"])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_neighbours_match_brute_force(spark, kind, k):
    rng = random.Random(5)
    if kind == "uniform":
        pts = [(rng.random(), rng.random()) for _ in range(300)]
    elif kind == "clustered":
        pts = [(rng.gauss(0, 0.001), rng.gauss(0, 0.001)) for _ in range(290)]
        pts += [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(10)]
    else:
        pts = [(float(rng.randint(0, 2)), float(rng.randint(0, 2))) for _ in range(300)]
    train = [(i, a, b, float(i)) for i, (a, b) in enumerate(pts)]
    queries = [(i, a + 0.01, b - 0.01) for i, (a, b) in enumerate(pts[::15])] + [(999, 80.0, -80.0)]
    t = spark.createDataFrame(train, "id int, x double, y double, v double")
    q = spark.createDataFrame(queries, "key int, x double, y double")
    near = nearest_neighbors(t, q, ["x", "y"], k, ["id"], ["key"], "v").collect()
    got = {}
    for r in sorted(near, key=lambda r: (r.key, r["rank"])):
        got.setdefault(r.key, []).append(r.v)
    want = brute_force(train, queries, k)
    assert set(got) == set(want)
    for key in want:
        if kind == "duplicates":
            assert sorted(got[key]) == sorted(want[key])
        else:
            assert got[key] == want[key]
    mean = {r.key: r.pred for r in knn_predict(t, q, ["x", "y"], "v", k, ["id"], ["key"]).collect()}
    assert mean == {key: pytest.approx(sum(v) / len(v)) for key, v in want.items()}


def test_gradients_are_derivatives(spark):
    losses = {
        "mse": lambda y, p: (p - y) ** 2 / 2,
        "squared_log": lambda y, p: (math.log1p(p) - math.log1p(y)) ** 2 / 2,
        "log_square": lambda y, p: math.log1p((p - y) ** 2),
        "mape": lambda y, p: 100 * abs(y - p) / max(abs(y), 1e-7),
        "log_abs": lambda y, p: math.log1p(abs(p - y)),
    }
    row = spark.createDataFrame([(0.7, 1.3)], "y double, p double")
    d = 1e-5
    for name, loss in losses.items():
        g, h = row.select(*scalars.gradients(name, F.col("y"), F.col("p"))).first()
        assert g == pytest.approx((loss(0.7, 1.3 + d) - loss(0.7, 1.3 - d)) / (2 * d), rel=1e-5)
        curve = (loss(0.7, 1.3 + d) - 2 * loss(0.7, 1.3) + loss(0.7, 1.3 - d)) / d**2
        assert h == pytest.approx(curve, abs=1e-3)


@pytest.mark.parametrize("objective", ["mse", "log_square", "log_abs", "mape"])
def test_boosting_lowers_its_loss(points, objective):
    model = fit_boosted(points, ["x1", "x2"], "y", objective, rounds=12, eta=0.3)
    scored = model.transform(points)
    after = scored.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    before = points.agg(F.avg(F.abs("y"))).first()[0]
    assert after < 0.7 * before


def test_tree_search_and_averaged_nets(points):
    labelled = points.withColumn("c", (F.col("y") > 0).cast("double"))
    nets = learners.NetEnsemble(["x1", "x2"], "c", [2, 4, 2], n_nets=2, max_iter=30).fit(labelled)
    out = nets.transform(labelled)
    assert out.where("abs(aggregate(probability, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0
    assert out.where("pred = c").count() > 500
