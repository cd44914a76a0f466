"""Rule models on tertile boundaries and tertile labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach


def _with_bounds(df: DataFrame, bounds: DataFrame, features: Sequence[str]) -> DataFrame:
    """Boundaries of each feature as columns ``_lo_i``/``_hi_i`` (one aggregated row)."""
    one = bounds.groupBy().agg(
        *[
            F.max(F.when(F.col("feature") == f, F.col(side))).alias(f"_{short}_{i}")
            for i, f in enumerate(features)
            for side, short in (("lower_bound", "lo"), ("upper_bound", "hi"))
        ]
    )
    return attach(df, one, [])


def sort_rule(df: DataFrame, bounds: DataFrame, feature: str) -> DataFrame:
    """Class 0 below the lower boundary, 1 below the upper one, else 2."""
    x = F.col(feature)
    rule = F.when(x < F.col("_lo_0"), 0).when(x < F.col("_hi_0"), 1).otherwise(2)
    return _with_bounds(df, bounds, [feature]).withColumn("pred", rule).drop("_lo_0", "_hi_0")


def two_factor_rule(df: DataFrame, bounds: DataFrame, growth: str, cash: str) -> DataFrame:
    """Low growth is class 0 and high growth class 2, where cash flow is not high; else 1."""
    g, low_cash = F.col(growth), F.col(cash) < F.col("_hi_1")
    rule = (
        F.when((g < F.col("_lo_0")) & low_cash, 0)
        .when((g > F.col("_hi_0")) & low_cash, 2)
        .otherwise(1)
    )
    out = _with_bounds(df, bounds, [growth, cash]).withColumn("pred", rule)
    return out.drop("_lo_0", "_hi_0", "_lo_1", "_hi_1")


def two_factor_rule_exact(df: DataFrame, growth_tertile: str, cash_tertile: str) -> DataFrame:
    """The same by tertile labels."""
    g, c = F.col(growth_tertile), F.col(cash_tertile)
    return df.withColumn("pred", F.when((g == 0) & (c != 0), 0).when((g == 2) & (c != 0), 2).otherwise(1))
