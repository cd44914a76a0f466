"""Portfolios, folds and splits against hand-made answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelloom.operators import returns, splits


@pytest.fixture(scope="module")
def cum(spark):
    rows = [
        ("2000-01-01", 1, 0.10), ("2000-01-01", 0, -0.05), ("2000-02-01", 0, 0.02),
        ("2000-03-01", 1, 0.05), ("2000-03-01", 0, 0.01),
    ]
    df = spark.createDataFrame(rows, "month string, cls int, r double").withColumn("month", F.to_date("month"))
    return returns.calculate_return(df, "month", "cls", [0, 1], "r").cache()


def test_compounding(cum):
    top = [round(r.cumulative_asset, 6) for r in cum.where("cls = 1").orderBy("month").collect()]
    bottom = [round(r.cumulative_asset, 6) for r in cum.where("cls = 0").orderBy("month").collect()]
    assert top == [1, 1.1, 1.1, 1.155]
    assert bottom == [1, 0.95, 0.969, 0.97869]


def test_spread_and_ratio(cum):
    rows = returns.calculate_diff_ir(cum, "month", "cls", 1, 0, "r").orderBy("month").collect()
    assert rows[0].month == dt.date(1999, 12, 1)
    assert rows[0].std_diff is None and rows[0].IR is None
    expected = [
        (0.15, 2.598068, 0.367423, 7.071046),
        (0.131, 0.943728, 0.321870, 2.932021),
        (0.17631, 0.862177, 0.262869, 3.279874),
    ]
    for row, want in zip(rows[1:], expected):
        assert tuple(row[1:]) == pytest.approx(want, abs=2e-6)


def test_constant_return_compounds(spark):
    rows = [(f"2001-{m:02d}-01", 0, 0.02) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "month string, cls int, r double").withColumn("month", F.to_date("month"))
    last = returns.calculate_return(df, "month", "cls", [0], "r").orderBy(F.desc("month")).first()
    assert last.cumulative_return == pytest.approx(1.02**12 - 1)
    assert last.annual_return == pytest.approx(1.02**12 - 1)


def test_validation_dates():
    folds = splits.val_dates(dt.date(2000, 1, 1), dt.date(2001, 12, 1), 3)
    assert folds == [
        (dt.date(2000, 1, 1), dt.date(2000, 8, 1)),
        (dt.date(2000, 9, 1), dt.date(2001, 4, 1)),
        (dt.date(2001, 5, 1), dt.date(2001, 12, 1)),
    ]
    forced = splits.val_dates(dt.date(2000, 1, 1), dt.date(2000, 6, 1), 3, force_val_length=1)
    assert forced[:2] == [(dt.date(2000, 1, 1),) * 2, (dt.date(2000, 2, 1),) * 2]


@pytest.mark.parametrize("future", [True, False])
def test_purging_and_embargo(spark, future):
    months = [(dt.date(2000 + i // 12, i % 12 + 1, 1),) for i in range(24)]
    df = spark.createDataFrame(months, "month date")
    folds = splits.val_dates(months[0][0], months[-1][0], 3)
    out = splits.purged_folds(df, "month", folds, 3, 1, future).where("fold = 1")
    train = sorted(r.month for r in out.where("role = 'train'").collect())
    val = sorted(r.month for r in out.where("role = 'val'").collect())
    early = [m[0] for m in months[:5]]
    late = [m[0] for m in months[20:]]
    assert train == early + (late if future else [])
    assert val == [m[0] for m in months[8:16]]


def test_entity_split_is_disjoint_and_repeatable(spark):
    rows = [(i % 3, i, m) for i in range(90) for m in range(2)]
    df = spark.createDataFrame(rows, "sector int, sec long, m int")
    out = splits.split_by_entity(df, "sec", "sector", 0.8, seed=3).cache()
    assert out.groupBy("sec").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    train = out.where("split = 'train'").select("sector", "sec").distinct().groupBy("sector").count()
    assert [r["count"] for r in train.collect()] == [24, 24, 24]
    again = splits.split_by_entity(df.repartition(5), "sec", "sector", 0.8, seed=3)
    assert again.exceptAll(out).count() == 0


def test_subsample_is_repeatable(spark):
    df = spark.range(20000)
    a = splits.subsample(df, ["id"], 0.3, 1)
    assert 0.27 < a.count() / 20000 < 0.33
    assert a.exceptAll(splits.subsample(df.repartition(5), ["id"], 0.3, 1)).count() == 0
    assert splits.subsample(df, ["id"], 0.3, 2).exceptAll(a).count() > 0


def test_grid_order(spark):
    grid = splits.expand_grid({"a": [1, 2], "b": ["x", "y"]})
    assert grid == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    assert splits.grid_table(spark, {"a": [1, 2]}).count() == 2
