"""Quantile classes and order statistics, by window and by selection."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import order_stats
from panelloom.operators.bins import discretize_by_month, discretize_by_value
from panelloom.operators.order_stats import quantiles

WAYS = [order_stats.HOT_ROWS, 0]


def one_month(spark, values):
    rows = [("2000-01-01", i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "month string, sec long, x double").withColumn(
        "month", F.to_date("month")
    )


def expected_bins(n_rows, n):
    """Right-closed intervals of equal width in rank, in whole numbers."""
    out = []
    for r in range(1, n_rows + 1):
        if n_rows == 1:
            out.append(0)
            continue
        i = 0
        while (r - 1) * n > (i + 1) * (n_rows - 1):
            i += 1
        out.append(i)
    return out


@pytest.mark.parametrize("hot", WAYS)
@pytest.mark.parametrize(
    "n_rows,n,sizes", [(10, 5, [2] * 5), (11, 5, [3, 2, 2, 2, 2]), (12, 5, [3, 2, 2, 2, 3])]
)
def test_bin_sizes(spark, hot, n_rows, n, sizes):
    out = discretize_by_month(one_month(spark, range(n_rows)), ["x"], n, "month", ["sec"], hot_rows=hot)
    got = {r[0]: r[1] for r in out.groupBy("x_discrete").count().collect()}
    assert [got[i] for i in range(n)] == sizes


@pytest.mark.parametrize("hot", WAYS)
def test_few_rows(spark, hot):
    three = discretize_by_month(one_month(spark, [1, 2, 3]), ["x"], 5, "month", ["sec"], hot_rows=hot)
    assert [r.x_discrete for r in three.orderBy("x").collect()] == [0, 2, 4]
    one = discretize_by_month(one_month(spark, [7]), ["x"], 5, "month", ["sec"], hot_rows=hot)
    assert one.first().x_discrete == 0


@pytest.mark.parametrize("hot", WAYS)
def test_missing_values_and_names(spark, hot):
    df = one_month(spark, [3, None, 1, float("nan"), 2])
    out = discretize_by_month(df, ["x"], 3, "month", ["sec"], [2, 1, 0], hot_rows=hot)
    assert [r.x_discrete for r in out.orderBy("sec").collect()] == [0, None, 2, None, 1]


def test_wrong_number_of_names(spark):
    with pytest.raises(ValueError):
        discretize_by_month(one_month(spark, [1, 2]), ["x"], 3, "month", ["sec"], ["a", "b"])


def test_both_ways_agree_on_skew_and_ties(spark):
    rng = random.Random(1)
    # One month holds most rows and one value a third of them.
    rows = []
    for i in range(9000):
        month = "2000-01-01" if rng.random() < 0.7 else f"2000-{rng.randint(2, 12):02d}-01"
        rows.append((month, i, 5.0 if rng.random() < 0.33 else float(rng.randint(0, 400)) / 8))
    df = spark.createDataFrame(rows, "month string, sec long, x double").repartition(7)
    a = discretize_by_month(df, ["x"], 7, "month", ["sec"])
    b = discretize_by_month(df.repartition(3, "sec"), ["x"], 7, "month", ["sec"], hot_rows=0)
    joined = a.join(b.withColumnRenamed("x_discrete", "other"), ["month", "sec"])
    assert joined.count() == 9000
    assert joined.where("not (x_discrete <=> other)").count() == 0
    first = [r.x_discrete for r in a.where("month = '2000-01-01'").orderBy("x", "sec").collect()]
    assert first == expected_bins(len(first), 7)


def test_a_missed_bracket_is_selected_again(spark, monkeypatch):
    """Brackets that contain no wanted rank must not change the result."""
    rows = [("m", i, float((i * 7919) % 5000)) for i in range(5000)]
    df = spark.createDataFrame(rows, "month string, sec long, x double")
    right = discretize_by_month(df, ["x"], 4, "month", ["sec"])
    real = order_stats._sketch

    def shifted(base, by, targets):
        out = real(base, by, targets)
        up = [F.transform(c, lambda v: v + 900).alias(c) for c in ("_low", "_high")]
        return out.select(*by, "_n", "_ranks", *up)

    monkeypatch.setattr(order_stats, "_sketch", shifted)
    got = discretize_by_month(df, ["x"], 4, "month", ["sec"], hot_rows=0)
    joined = right.join(got.withColumnRenamed("x_discrete", "other"), ["month", "sec"])
    assert joined.where("not (x_discrete <=> other)").count() == 0


@pytest.mark.parametrize("hot", WAYS)
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_match_numpy(spark, hot, by):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3 == 0), float(v), float(v) ** 2) for i, v in enumerate(rng.normal(size=2500))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    probs = [0.0, 0.03, 0.5, 0.97, 1.0]
    for row in quantiles(df, by, ["x", "y"], probs, hot).collect():
        part = [r for r in rows if not by or r[0] == row["g"]]
        for column, at in (("q_x", 1), ("q_y", 2)):
            np.testing.assert_allclose(row[column], np.quantile([r[at] for r in part], probs), rtol=1e-12)


def test_value_bins(spark):
    out = discretize_by_value(one_month(spark, [1, 2, 3, 4, None]), "x", 2, ["low", "high"], "cls")
    assert [r.cls for r in out.orderBy("sec").collect()] == ["low", "low", "high", "high", None]
