"""Linear models from sums: one aggregation per fit, however many groups are fitted.

A ridge fit only needs counts, sums and products of the features and the label. Those
are combined map-side, add up over months, folds and windows, and fit in one row, so
cross-validation and walk-forward fits never rescan the panel per model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import attach
from .profile import mean_median_by


def moment_names(p: int) -> list[str]:
    names = ["n", "sy"] + [f"sx_{i}" for i in range(p)] + [f"sxy_{i}" for i in range(p)]
    return names + [f"sxx_{i}_{j}" for i in range(p) for j in range(i, p)]


def moments(
    df: DataFrame, features: Sequence[str | Column], label: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Count, sums and products of complete rows, one row per group."""
    x = [F.col(f).cast("double") if isinstance(f, str) else f for f in features]
    y = F.col(label).cast("double") if isinstance(label, str) else label
    rows = df.select(*by, y.alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    p = len(x)
    rows = rows.na.drop(subset=["_y", *[f"_x{i}" for i in range(p)]])
    x, y = [F.col(f"_x{i}") for i in range(p)], F.col("_y")
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy")]
    sums += [F.sum(x[i]).alias(f"sx_{i}") for i in range(p)]
    sums += [F.sum(x[i] * y).alias(f"sxy_{i}") for i in range(p)]
    sums += [F.sum(x[i] * x[j]).alias(f"sxx_{i}_{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy(*by).agg(*sums)


def add_moments(stats: DataFrame, by: Sequence[str], p: int) -> DataFrame:
    """Sum moment rows into coarser groups."""
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in moment_names(p)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(matrix: pd.Series, right: pd.Series) -> pd.Series:
    """Solve one small system per row (rows are fitted models, not data)."""

    def one(a, b):
        b = np.asarray(b, dtype=float)
        a = np.asarray(a, dtype=float).reshape(len(b), len(b))
        try:
            return np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            return None

    return pd.Series([one(a, b) for a, b in zip(matrix, right)])


def solve_ridge(
    stats: DataFrame, p: int, alpha: float | Column = 0.0, fit_intercept: bool = True
) -> DataFrame:
    """Add ``intercept`` and ``coef_0..`` to moment rows; ``alpha`` may be a column.

    The penalty is on the coefficients, not the intercept. One and two features are
    solved in column arithmetic; singular systems give NULL.
    """
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    n = F.col("n")

    def sxx(i, j):
        raw = F.col(f"sxx_{min(i, j)}_{max(i, j)}")
        out = raw - F.col(f"sx_{i}") * F.col(f"sx_{j}") / n if fit_intercept else raw
        return out + a if i == j else out

    def sxy(i):
        raw = F.col(f"sxy_{i}")
        return raw - F.col(f"sx_{i}") * F.col("sy") / n if fit_intercept else raw

    def over(top, bottom):
        return top / F.nullif(bottom, F.lit(0.0))

    if p == 1:
        coefs = {"coef_0": over(sxy(0), sxx(0, 0))}
    elif p == 2:
        det = sxx(0, 0) * sxx(1, 1) - sxx(0, 1) * sxx(0, 1)
        coefs = {
            "coef_0": over(sxy(0) * sxx(1, 1) - sxy(1) * sxx(0, 1), det),
            "coef_1": over(sxy(1) * sxx(0, 0) - sxy(0) * sxx(0, 1), det),
        }
    else:
        matrix = F.array(*[sxx(i, j) for i in range(p) for j in range(p)])
        stats = stats.withColumn("_beta", _solve(matrix, F.array(*[sxy(i) for i in range(p)])))
        coefs = {f"coef_{i}": F.col("_beta")[i] for i in range(p)}
    out = stats.withColumns(coefs)
    intercept = F.lit(0.0)
    if fit_intercept:
        intercept = F.col("sy") / n
        for i in range(p):
            intercept = intercept - F.col(f"coef_{i}") * F.col(f"sx_{i}") / n
    return out.withColumn("intercept", intercept).drop("_beta")


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    alpha: float = 0.0,
    fit_intercept: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Ridge (alpha 0: least squares) of every group: n, intercept and coefficients."""
    p = len(features)
    solved = solve_ridge(moments(df, features, label, by), p, alpha, fit_intercept)
    return solved.select(*by, "n", "intercept", *[f"coef_{i}" for i in range(p)])


def linear_score(features: Sequence[str | Column]) -> Column:
    """``intercept + sum(coef_i * feature_i)`` from joined coefficient columns."""
    out = F.col("intercept")
    for i, f in enumerate(features):
        out = out + F.col(f"coef_{i}") * (F.col(f) if isinstance(f, str) else f)
    return out


def predict_linear(
    df: DataFrame,
    coefs: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    output: str = "pred",
    how: str = "left",
) -> DataFrame:
    """Score rows with the coefficients of their group."""
    keep = ["intercept", *[f"coef_{i}" for i in range(len(features))]]
    extra = [c for c in coefs.columns if c in ("model_id",) and c not in by]
    scored = attach(df, coefs.select(*by, *extra, *keep), list(by), how)
    return scored.withColumn(output, linear_score(features)).drop(*keep)


def expanding_fits(
    df: DataFrame,
    date: str,
    features: Sequence[str],
    label: str,
    test_begin,
    alpha: float = 0.0,
    fit_intercept: bool = True,
) -> DataFrame:
    """Coefficients for every test month, trained on all rows before that month.

    Monthly sums are accumulated by one window over the calendar.
    """
    p = len(features)
    # Months without complete rows still need their fit, hence the outer list of months.
    months = df.groupBy(date).agg(F.lit(1).alias("_one"))
    monthly = months.join(moments(df, features, label, [date]), date, "left")
    before = W.partitionBy("_one").orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    grown = monthly.select(date, *[F.sum(c).over(before).alias(c) for c in moment_names(p)])
    begin = F.lit(test_begin).cast("date")
    solved = solve_ridge(grown.where(F.col(date) >= begin), p, alpha, fit_intercept)
    return solved.select(date, "n", "intercept", *[f"coef_{i}" for i in range(p)])


def walk_forward(
    df: DataFrame,
    date: str,
    features: Sequence[str],
    label: str,
    test_begin,
    test_end,
    alpha: float = 0.0,
    fit_intercept: bool = True,
) -> DataFrame:
    """Predictions of every test month by the model trained before it."""
    end = F.lit(test_end).cast("date")
    upto = df.where(F.col(date) <= end)
    fits = expanding_fits(upto, date, features, label, test_begin, alpha, fit_intercept)
    test = upto.where(F.col(date) >= F.lit(test_begin).cast("date"))
    return predict_linear(test, fits, features, [date])


def panel_regression(df: DataFrame, date: str, x: str, y: str) -> DataFrame:
    """Least squares per month with HC3 errors of slope and intercept.

    Two grouped passes: the fit, then the weighted residuals against the joined fit.
    Months with fewer than three rows or constant x have NULL.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        date, F.col(x).alias("_x"), F.col(y).alias("_y")
    )
    fit = rows.groupBy(date).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_x").alias("_xm"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
    )
    good = (F.col("n") >= 3) & (F.col("_sxx") > 0)
    fit = fit.withColumns({c: F.when(good, F.col(c)) for c in ("_sxx", "slope", "intercept")})
    joined = attach(rows, fit, [date])
    d = F.col("_x") - F.col("_xm")
    lever = 1 / F.col("n") + d * d / F.col("_sxx")
    e = F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")
    # A leverage of one fits its row exactly; it has no HC3 error.
    q = e / F.nullif(1 - lever, F.lit(0.0))
    w = 1 / F.col("n") - F.col("_xm") * d / F.col("_sxx")
    return joined.groupBy(date).agg(
        F.first("n").alias("n"),
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        F.sqrt(F.sum(d * d * q * q) / F.first(F.col("_sxx") * F.col("_sxx"))).alias("slope_se"),
        F.sqrt(F.sum(w * w * q * q)).alias("intercept_se"),
    )


def panel_regression_by_period(
    monthly: DataFrame, period: str, column: str = "slope"
) -> DataFrame:
    """Mean and median monthly slope of each period."""
    return mean_median_by(monthly, [period], column)


def fit_blend(df: DataFrame, pred: str, edge: str, label: str) -> DataFrame:
    """Weights of predicted residual and edge that explain residual plus edge."""
    total = F.col(label) + F.col(edge)
    solved = solve_ridge(moments(df, [pred, edge], total), 2, 0.0, fit_intercept=False)
    return solved.select("intercept", "coef_0", "coef_1")


def blend(
    df: DataFrame, weights: DataFrame, pred: str, edge: str, output: str = "pred_return"
) -> DataFrame:
    """Blended return prediction."""
    return predict_linear(df, weights, [pred, edge], output=output)
