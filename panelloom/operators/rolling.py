"""Rolling means, lags and the regime flag; all on tables of months x groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import group_label
from .profile import standard_error


def dense_means(df: DataFrame, date: str, group: str, value: str) -> DataFrame:
    """Mean per (date, group) for every date x group that occurs; NULL where there is none.

    The months' groups are folded into a map and the list of all groups is one
    aggregated row, so the grid is filled without a cross join.
    """
    means = df.where(F.col(group).isNotNull()).groupBy(date, group).agg(F.avg(value).alias(value))
    months = means.groupBy(date).agg(
        F.map_from_entries(F.collect_list(F.struct(group, value))).alias("_m")
    )
    groups = means.agg(F.array_sort(F.collect_set(group)).alias("_g"))
    # Aggregated tables: months rows on one side, a single row on the other.
    grid = months.withColumn("_k", F.lit(1)).join(
        F.broadcast(groups.withColumn("_k", F.lit(1))), "_k"
    )
    return grid.select(date, "_m", F.explode("_g").alias(group)).select(
        date, group, F.try_element_at("_m", F.col(group)).alias(value)
    )


def rolling_mean(
    dense: DataFrame, date: str, value: str, window: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean of the last ``window`` dates; NULL unless all of them have a value."""
    w = (
        W.partitionBy(*(list(keys) or [F.lit(1)]))
        .orderBy(date)
        .rowsBetween(-(window - 1), 0)
    )
    full = F.count(value).over(w) == window
    return dense.withColumn(f"{value}_roll", F.when(full, F.avg(value).over(w)))


def lag_difference(
    series: DataFrame, date: str, columns: Sequence[str], periods: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Row-based difference to ``periods`` dates earlier, on a one-row-per-date series."""
    w = W.partitionBy(*(list(keys) or [F.lit(1)])).orderBy(date)
    return series.withColumns(
        {f"{c}_diff": F.col(c) - F.lag(c, periods).over(w) for c in columns}
    )


def reversal_flag(
    rolled: DataFrame, date: str, group: str, value: str, top, bottom, threshold: float = 0.0
) -> DataFrame:
    """1 in the months in which the top group's value exceeds the bottom's by more than
    the threshold; 0 otherwise, also while the spread is unknown."""

    def at(g):
        return F.max(F.when(F.col(group) == F.lit(g), F.col(value)))

    spread = rolled.groupBy(date).agg((at(top) - at(bottom)).alias("spread"))
    flag = F.coalesce(F.col("spread") > F.lit(float(threshold)), F.lit(False))
    return spread.withColumn("reversal", flag.cast("int"))


def two_factor_rolling(
    df: DataFrame,
    date: str,
    parts: Sequence[tuple[str, str]],
    value: str,
    window: int,
    conf: float = 1.0,
    series: DataFrame | None = None,
    series_columns: Sequence[str] = (),
) -> DataFrame:
    """Rolling return of every pair of classes with the month's standard error.

    Market series may be added as further groups with error 0.
    """
    labelled = df.withColumn("group", group_label(parts)).where(
        " and ".join(f"`{c}` is not null" for _, c in parts)
    )
    rolled = rolling_mean(dense_means(labelled, date, "group", value), date, value, window, ["group"])
    error = labelled.groupBy(date, "group").agg(
        standard_error(F.stddev_samp(value), F.count(value), conf).alias("err")
    )
    out = rolled.join(error, [date, "group"], "inner").select(
        date, "group", F.col(f"{value}_roll").alias(value), "err"
    )
    out = out.where(F.col(value).isNotNull() & F.col("err").isNotNull())
    if series is not None:
        extra = series.unpivot([date], list(series_columns), "group", value)
        out = out.unionByName(extra.withColumn("err", F.lit(0.0)))
    return out
