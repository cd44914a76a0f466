"""Missing values, infinities and limits in branches that the oracle queries do not reach."""

import math

from pyspark.sql import functions as F

from panelloom.operators.bins import discretize_by_value
from panelloom.operators.boosting import fit_boosted
from panelloom.operators.clean import standardize, winsorize
from panelloom.operators.order_stats import quantiles
from panelloom.operators.selection import anova

NAN, INF = float("nan"), float("inf")


def test_quantiles_with_infinities_agree_both_ways(spark):
    rows = [("a", x) for x in (1.0, INF, INF, INF, None, NAN, -0.0)] + [("b", x) for x in (-INF, -INF, 2.0)]
    rows += [("c", None), ("c", NAN)]
    df = spark.createDataFrame(rows, "g string, x double")
    for probs in ([0.0, 1.0], [0.5, 0.9]):
        few = {r["g"]: r["q_x"] for r in quantiles(df, ["g"], ["x"], probs).collect()}
        many = {r["g"]: r["q_x"] for r in quantiles(df, ["g"], ["x"], probs, hot_rows=0).collect()}
        assert many["a"] == few["a"] and not any(math.isnan(v) for v in many["a"])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(NAN,), (None,)], "x double")
    clipped = [r["x"] for r in winsorize(df, ["x"], 0.25, 0.75).collect()]
    assert clipped[:5] == [2.0, 2.0, 3.0, 4.0, 4.0] and clipped[5:] == [None, None]
    scaled = [r["x"] for r in standardize(df, ["x"]).collect()]
    assert abs(sum(scaled[:5])) < 1e-9 and scaled[2] == 0.0 and scaled[5:] == [None, None]
    bins = [r["x_discrete"] for r in discretize_by_value(df, "x", 5).collect()]
    assert bins[-2:] == [None, None] and bins[4] == 4


def test_boosting_reaches_group_means_and_keeps_rows(spark):
    rows = [(0.0, 100.0), (0.0, 110.0), (1.0, 200.0), (1.0, 210.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    model = fit_boosted(df, ["x"], "y", "mse", rounds=1, eta=1.0, max_depth=1)
    scored = model.transform(df.unionByName(spark.createDataFrame([(None, 1.0), (NAN, 1.0)], "x double, y double")))
    pred = [r["pred"] for r in scored.collect()]
    assert [round(p, 6) for p in pred[:4]] == [105.0, 105.0, 205.0, 205.0] and pred[4:] == [None, None]


def test_anova_of_equal_folds(spark):
    rows = [("r2", m, fold, float(m)) for m in range(3) for fold in range(3)]
    long = spark.createDataFrame(rows, "metric string, model_id int, fold int, value double")
    r = anova(long, ["metric"]).first()
    assert r["f_stat"] == INF and r["p_value"] == 0.0
    same = anova(long.withColumn("value", F.lit(1.0)), ["metric"]).first()
    assert same["f_stat"] is None
