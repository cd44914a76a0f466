"""Quantile portfolios: class returns, compounding, spreads and information ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def class_returns(
    df: DataFrame, date: str, cls: str, ret: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean return per (keys, date, class); everything after this is months x classes."""
    return df.where(F.col(cls).isNotNull()).groupBy(*keys, date, cls).agg(F.avg(ret).alias(ret))


def complete_classes(
    means: DataFrame, date: str, cls: str, classes: Sequence, ret: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Every class in every month that has any; absent ones have return 0.

    Works on the aggregated table by folding each month's classes into one map, so a
    missing class is a missing map entry and no second scan or join is needed.
    """
    kind = dict(means.dtypes)[cls]
    listed = F.array(*[F.lit(c).cast(kind) for c in classes])
    months = means.groupBy(*keys, date).agg(
        F.map_from_entries(F.collect_list(F.struct(cls, ret))).alias("_by_class")
    )
    return months.select(*keys, date, "_by_class", F.explode(listed).alias(cls)).select(
        *keys, date, cls, F.coalesce(F.try_element_at("_by_class", F.col(cls)), F.lit(0.0)).alias(ret)
    )


def calculate_return(
    df: DataFrame, date: str, cls: str, classes: Sequence, ret: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Cumulative asset, cumulative return and annualised return of each class.

    A zero return one month before the first month seeds every class with asset 1.
    ``keys`` (model, split, sector) run any number of backtests in one job.
    """
    keys = list(keys)
    dense = complete_classes(class_returns(df, date, cls, ret, keys), date, cls, classes, ret, keys)
    seed = dense.groupBy(*keys, cls).agg(
        F.add_months(F.min(date), -1).alias(date), F.lit(0.0).alias(ret)
    )
    rows = dense.unionByName(seed)
    # One row per month and class: a window partition is as long as the calendar.
    upto = W.partitionBy(*keys, cls).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    asset = F.product(1 + F.col(ret)).over(upto)
    t = F.count(F.lit(1)).over(upto) - 1
    out = rows.withColumn("cumulative_asset", asset).withColumn("_t", t)
    annual = F.when(
        F.col("_t") > 0, F.pow("cumulative_asset", F.lit(12.0) / F.nullif("_t", F.lit(0))) - 1
    ).otherwise(0.0)
    return out.select(
        *keys,
        date,
        cls,
        ret,
        "cumulative_asset",
        (F.col("cumulative_asset") - 1).alias("cumulative_return"),
        annual.alias("annual_return"),
    )


def _by_date(cum: DataFrame, date: str, cls: str, top, bottom, columns, keys) -> DataFrame:
    """Top minus bottom per date in one grouped pass; a missing side gives NULL."""

    def of(c, which):
        return F.max(F.when(F.col(cls) == F.lit(which), F.col(c)))

    return (
        cum.where(F.col(cls).isin(top, bottom))
        .groupBy(*keys, date)
        .agg(*[(of(c, top) - of(c, bottom)).alias(f"{c}_diff") for c in columns])
    )


def calculate_diff_return(
    cum: DataFrame, date: str, cls: str, top, bottom, keys: Sequence[str] = ()
) -> DataFrame:
    """Top minus bottom cumulative return."""
    return _by_date(cum, date, cls, top, bottom, ["cumulative_return"], keys)


def calculate_diff_ir(
    cum: DataFrame, date: str, cls: str, top, bottom, ret: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Spread of cumulative and annual return, its annualised risk and the ratio of both."""
    columns = ["cumulative_return", "annual_return", ret]
    diff = _by_date(cum, date, cls, top, bottom, columns, keys)
    # One row per month; the partition is a calendar even when there are no keys.
    upto = (
        W.partitionBy(*(list(keys) or [F.lit(1)]))
        .orderBy(date)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    std = F.stddev_samp(f"{ret}_diff").over(upto) * F.sqrt(F.lit(12.0))
    out = diff.withColumn("std_diff", std)
    return out.select(
        *keys,
        date,
        "cumulative_return_diff",
        "annual_return_diff",
        "std_diff",
        (F.col("annual_return_diff") / F.nullif("std_diff", F.lit(0.0))).alias("IR"),
    )


def monthly_spread(
    df: DataFrame, date: str, cls: str, top, bottom, ret: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean return of the top class minus the bottom class per month (NULL if one lacks)."""

    def mean_of(which):
        return F.avg(F.when(F.col(cls) == F.lit(which), F.col(ret)))

    return df.groupBy(*keys, date).agg((mean_of(top) - mean_of(bottom)).alias("spread"))


def perform_backtest(
    pred: DataFrame,
    date: str,
    cls: str,
    classes: Sequence,
    ret: str,
    top,
    bottom,
    keys: Sequence[str] = ("split",),
) -> dict[str, DataFrame]:
    """Cumulative returns and spreads of train and test (or any other keys) at once."""
    cum = calculate_return(pred, date, cls, classes, ret, keys)
    return {"cum_return": cum, "diff": calculate_diff_ir(cum, date, cls, top, bottom, ret, keys)}


def latest_row(spread: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """The newest row of a spread table."""
    rest = [c for c in spread.columns if c not in keys]
    return (
        spread.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(date)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def sector_spreads(
    df: DataFrame, date: str, cls: str, classes: Sequence, ret: str, top, bottom, sector: str
) -> DataFrame:
    """Cumulative top-minus-bottom return of every sector, long."""
    cum = calculate_return(df.where(F.col(sector).isNotNull()), date, cls, classes, ret, [sector])
    return calculate_diff_return(cum, date, cls, top, bottom, [sector])


def widen(df: DataFrame, ids: Sequence[str], names: str, values: Sequence, column: str) -> DataFrame:
    """One column per listed value (explicit values: no extra pass to find them)."""
    return df.groupBy(*ids).pivot(names, list(values)).agg(F.first(column, ignorenulls=True))


def model_comparison(
    cum: DataFrame, date: str, cls: str, top, bottom, models: Sequence[str], model: str = "model"
) -> DataFrame:
    """Spread series of the listed models out of one table partitioned by model."""
    chosen = cum.where(F.col(model).isin(list(models)))
    return calculate_diff_return(chosen, date, cls, top, bottom, [model])
