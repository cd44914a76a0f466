"""Row cleaning, imputation, winsorizing and standardising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import attach
from .order_stats import HOT_ROWS, quantiles

INF = float("inf")
# Fixed value: the sector code that stands for a missing one.
UNKNOWN_SECTOR = 99999999


def remove_missing_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Drop rows in which any target is missing."""
    return df.na.drop(subset=list(targets))


def drop_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which any listed column is infinite (missing values stay)."""
    finite = F.lit(True)
    for c in columns:
        finite = finite & ~F.coalesce(F.abs(F.col(c)) == F.lit(INF), F.lit(False))
    return df.where(finite)


def impute_by_month(df: DataFrame, features: Sequence[str], value: float = 0.0) -> DataFrame:
    """Missing values become 0, which is the month's mean of z-scored factors."""
    return df.na.fill({f: value for f in features})


def _as_of(df: DataFrame, features, security: str, date: str, ties, how: str) -> DataFrame:
    """Per (security, date): the last known or the mean value up to and including it.

    Rows are first combined per security and date, so what a window has to order is a
    security's calendar, however many rows it has.
    """
    order = F.struct(*ties) if ties else F.lit(0)
    per = W.partitionBy(security).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    aggs = []
    for f in features:
        known = F.col(f).isNotNull()
        aggs.append(F.max_by(F.when(known, F.col(f)), F.when(known, order)).alias(f"_l_{f}"))
        aggs.append(F.sum(f).alias(f"_s_{f}"))
        aggs.append(F.count(f).alias(f"_c_{f}"))
    daily = df.groupBy(security, date).agg(*aggs)
    fill = []
    for f in features:
        if how == "forward":
            fill.append(F.last(f"_l_{f}", ignorenulls=True).over(per).alias(f"_fill_{f}"))
        else:
            count = F.nullif(F.sum(f"_c_{f}").over(per), F.lit(0))
            fill.append((F.sum(f"_s_{f}").over(per) / count).alias(f"_fill_{f}"))
    return daily.select(security, date, *fill)


def impute_data(
    df: DataFrame,
    method: str,
    features: Sequence[str],
    security: str | None = None,
    date: str | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Impute by ``month`` (zero), ``securityId_ff`` (last known value of the security up
    to that date) or ``securityId_average`` (its running mean)."""
    features = list(features)
    if method == "month":
        return impute_by_month(df, features)
    how = {"securityId_ff": "forward", "securityId_average": "average"}[method]
    fill = _as_of(df, features, security, date, list(ties), how)
    out = df.join(fill, [security, date], "left")
    filled = {f: F.coalesce(F.col(f), F.col(f"_fill_{f}")) for f in features}
    return out.withColumns(filled).select(*df.columns)


def negate(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``-<feature>`` columns."""
    return df.withColumns({f"-{f}": -F.col(f) for f in features})


def adjusted_edge(
    df: DataFrame, edge: str, corrections: Sequence[str], ret: str, names=("Edge_Adj", "Residual")
) -> DataFrame:
    """Edge without its corrections, and the part of the return it leaves unexplained."""
    adj = F.col(edge)
    for c in corrections:
        adj = adj - F.col(c)
    return df.withColumn(names[0], adj).withColumn(names[1], F.col(ret) - F.col(names[0]))


def known(column: str) -> Column:
    """A column as double in which NaN is missing like NULL."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Limit to [low, high]; a missing value (NULL or NaN) stays missing."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, high), low))


def winsorize(
    df: DataFrame,
    features: Sequence[str],
    lower: float,
    upper: float,
    by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Clip to the exact quantiles of the whole frame, or of each ``by`` group.

    Only the limits are aggregated; they are joined back onto the rows, which are not
    shuffled.
    """
    by = list(by or [])
    limits = quantiles(df, by, features, [lower, upper], hot_rows)
    out = attach(df, limits, by)
    clipped = {
        f: clip(F.col(f).cast("double"), F.col(f"q_{f}")[0], F.col(f"q_{f}")[1]) for f in features
    }
    return out.withColumns(clipped).select(*df.columns)


def standardize(
    df: DataFrame, features: Sequence[str], by: Sequence[str] | None = None, center: str = "mean"
) -> DataFrame:
    """``(x - mean or median) / sample std`` over the whole frame or each ``by`` group.

    Missing values (NULL or NaN) count for nothing and stay missing.
    """
    by = list(by or [])
    aggs = [F.stddev_samp(known(f)).alias(f"_d_{f}") for f in features]
    if center == "mean":
        aggs += [F.avg(known(f)).alias(f"_m_{f}") for f in features]
    stats = df.groupBy(*by).agg(*aggs)
    out = attach(df, stats, by)
    if center == "median":
        mid = quantiles(df, by, features, [0.5])
        out = attach(out, mid, by)
    middle = {
        f: F.col(f"_m_{f}") if center == "mean" else F.col(f"q_{f}")[0] for f in features
    }
    scaled = {
        f: (known(f) - middle[f]) / F.nullif(F.col(f"_d_{f}"), F.lit(0.0)) for f in features
    }
    return out.withColumns(scaled).select(*df.columns)


def standardize_by_group(
    df: DataFrame,
    target: Sequence[str],
    groupby: Sequence[str],
    aggregate: str = "median",
    lower: float | None = None,
    upper: float | None = None,
    limit: float | None = None,
) -> DataFrame:
    """Winsorize per group, then centre and scale the *winsorized* values per group.

    ``limit`` finally clamps the scores to [-limit, limit] (the production recipe).
    """
    out = df
    if lower is not None and upper is not None:
        out = winsorize(out, target, lower, upper, groupby)
    out = standardize(out, target, groupby, aggregate)
    if limit is not None:
        lo, hi = F.lit(-float(limit)), F.lit(float(limit))
        out = out.withColumns({f: clip(F.col(f), lo, hi) for f in target})
    return out


def relative_return(df: DataFrame, ret: str, month: str, output: str) -> DataFrame:
    """Return minus the month's mean: aggregated and joined back, so that a month of any
    size is combined map-side instead of being gathered by a window."""
    mean = df.groupBy(month).agg(F.avg(ret).alias("_mean"))
    return attach(df, mean, [month]).withColumn(output, F.col(ret) - F.col("_mean")).drop("_mean")
