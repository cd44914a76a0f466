"""Cleaning, profiles and figure tables."""

import math

import pytest
from pyspark.sql import functions as F

from panelloom.functions import dates, scalars
from panelloom.operators import clean, interpret, linear, profile, rolling
from panelloom.plans.prepare import PrepareConfig, prepare_panel


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {kind}")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("hot", [10**9, 0])
def test_winsorize_and_scale(spark, hot):
    df = column(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    cut = clean.winsorize(df, ["x"], 0.25, 0.75, hot_rows=hot)
    assert values(cut) == [2, 2, 3, 4, 4]
    assert values(clean.standardize(cut, ["x"])) == pytest.approx([-1, -1, 0, 1, 1])
    both = clean.standardize_by_group(df.withColumn("g", F.lit(1)), ["x"], ["g"], "median", 0.25, 0.75, limit=0.5)
    assert values(both) == pytest.approx([-0.5, -0.5, 0, 0.5, 0.5])


def test_missing_stays_missing_when_clipped(spark):
    assert values(clean.winsorize(column(spark, [1.0, None, 9.0]), ["x"], 0.0, 1.0)) == [1, None, 9]


def test_imputation_by_security(spark):
    rows = [("a", "2000-01-01", 1.0), ("a", "2000-02-01", None), ("a", "2000-03-01", 4.0),
            ("a", "2000-04-01", None), ("b", "2000-02-01", None)]
    df = spark.createDataFrame(rows, "s string, d string, x double")
    fill = {r.s + r.d[5:7]: r.x for r in clean.impute_data(df, "securityId_ff", ["x"], "s", "d").collect()}
    assert fill == {"a01": 1, "a02": 1, "a03": 4, "a04": 4, "b02": None}
    mean = {r.s + r.d[5:7]: r.x for r in clean.impute_data(df, "securityId_average", ["x"], "s", "d").collect()}
    assert mean == {"a01": 1, "a02": 1, "a03": 4, "a04": 2.5, "b02": None}


def test_infinite_rows_of_every_column_are_dropped(spark):
    inf = math.inf
    df = spark.createDataFrame([(1.0, 1.0), (inf, 1.0), (1.0, -inf), (None, 1.0)], "a double, b double")
    assert clean.drop_infinite(df, ["a", "b"]).count() == 2


def test_margins_come_from_raw_rows(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 1, 9.0), (1, 1, 4.0)], "a int, b int, v double")
    for hot in (10**9, 0):
        t = {(r.bin_x, r.bin_y): r for r in profile.two_way_table(df, "a", "b", "v", hot_rows=hot).collect()}
        assert t["All", "All"].mean == 4 and t["All", "All"].median == 3
        assert t["0", "All"].mean == 4 and t["All", "1"].median == 6.5
        assert t["0", "0"].mean_err == pytest.approx(math.sqrt(0.5) / math.sqrt(2))


def test_null_inf_and_zero_shares(spark):
    df = spark.createDataFrame([(None, 0.0), (math.nan, math.inf), (1.0, 0.0), (2.0, 3.0)], "a double, b double")
    nulls = {r.feature: r.null_share for r in profile.count_null(df, ["a", "b"]).collect()}
    assert nulls == {"a": 0.5, "b": 0.0}
    assert {r.feature: r.inf_share for r in profile.count_inf(df, ["a", "b"]).collect()} == {"a": 0, "b": 0.25}
    assert {r.feature: r.n_zero for r in profile.count_zero(df, ["a", "b"]).collect()} == {"a": 0, "b": 2}


def test_scalars(spark):
    df = spark.createDataFrame([(729025, 45103010.0), (729056, 99999999.0)], "d int, c double")
    rows = df.select(dates.from_daynum(F.col("d")).alias("d"), scalars.code_prefix(F.col("c")).alias("c")).collect()
    assert [(str(r.d), r.c) for r in rows] == [("1996-01-01", 45.0), ("1996-02-01", 99.0)]


def test_rolling_mean_needs_full_windows(spark):
    rows = [(f"2000-{m:02d}-01", "g", float(m)) for m in (1, 2, 3, 4)] + [("2000-05-01", "h", 1.0)]
    df = spark.createDataFrame(rows, "d string, g string, v double")
    out = rolling.rolling_mean(rolling.dense_means(df, "d", "g", "v"), "d", "v", 2, ["g"])
    got = {(r.d[5:7], r.g): r.v_roll for r in out.collect()}
    assert got["01", "g"] is None and got["02", "g"] == 1.5 and got["05", "g"] is None
    assert len(got) == 10


def test_histogram_closes_its_last_bin(spark):
    out = {r.bin: r.n for r in interpret.histogram(column(spark, [0.0, 1.0, 2.0, 4.0]), "x", 4).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 1}
    dens = interpret.histogram(column(spark, [0.0, 1.0, 2.0, 4.0]), "x", 4, density=True)
    assert dens.agg(F.sum("density")).first()[0] == pytest.approx(1.0)
    same = interpret.histogram(column(spark, [3.0, 3.0]), "x", 4).collect()
    assert [(r.bin, r.n) for r in same] == [(0, 2)]


def test_box_statistics(spark):
    df = column(spark, [1.0, 2.0, 3.0, 4.0, 100.0]).withColumn("g", F.lit("a"))
    r = interpret.box_statistics(df, ["g"], "x").first()
    assert (r.q1, r.q2, r.q3, r.low_whisker, r.high_whisker, r.n_outliers) == (2, 3, 4, 1, 4, 1)


def test_mesh_is_half_open(spark):
    pts = {(r.a, r.b) for r in interpret.mesh(spark, ["a", "b"], [(0, 1), (0, 2)], 0.5).collect()}
    assert pts == {(a / 2, b / 2) for a in range(2) for b in range(4)}


def test_partial_dependence_of_a_linear_model_is_linear(spark):
    rows = [(float(i), float(i * i % 7), 2.0 * i - (i * i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    coefs = linear.fit_ridge(df, ["a", "b"], "y")
    out = interpret.partial_dependence(
        df, ["a", "b"], ["a"], lambda d: linear.predict_linear(d, coefs, ["a", "b"]), ["pred"], 5
    ).orderBy("a").collect()
    steps = [(q.mean_pred - p.mean_pred) / (q.a - p.a) for p, q in zip(out, out[1:])]
    assert steps == pytest.approx([2.0] * 4)


def test_prepare_panel(spark):
    rows = [("2000-01-01", i, float(i), float(i % 4) if i else None) for i in range(12)]
    df = spark.createDataFrame(rows, "m string, s long, x double, y double")
    out = prepare_panel(df, PrepareConfig("m", ["s"], ["x"], targets=["y"], negated=["x"], standardize="mean", bins=[("y", 2, "cls")]))
    assert out.count() == 11 and {"-x", "y_cls"} <= set(out.columns)
    assert out.agg(F.avg("x")).first()[0] == pytest.approx(0, abs=1e-12)
