"""Descriptive tables: missing shares, statistics, one- and two-way summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import attach
from .bins import discretize_by_month
from .order_stats import HOT_ROWS, quantiles


def _shares(df: DataFrame, columns, by, test, name: str) -> DataFrame:
    """Share of rows passing ``test`` per column: one aggregation, then long."""
    wide = df.groupBy(*by).agg(
        *[F.avg(F.coalesce(test(F.col(c)), F.lit(False)).cast("double")).alias(c) for c in columns]
    )
    return wide.unpivot(list(by), list(columns), "feature", name)


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double"))


def count_null(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of missing values per column, of the frame or per period."""
    return _shares(df, columns, by, _missing, "null_share")


def count_inf(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of positive infinity per column and period."""
    return _shares(df, columns, by, lambda x: x == F.lit(float("inf")), "inf_share")


def count_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number and share of zeros per column."""
    out = df.agg(
        *[F.count_if(F.col(c) == 0).alias(f"n_{c}") for c in columns],
        F.count(F.lit(1)).alias("_rows"),
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n_{c}").alias("n_zero"),
            (F.col(f"n_{c}") / F.nullif("_rows", F.lit(0))).alias("zero_share"),
        )
        for c in columns
    ]
    return out.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def statistics(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean, median, std, min and max of every feature per group (dataset)."""
    by, features = list(by), list(features)
    sums = df.groupBy(*by).agg(
        *[
            F.struct(
                F.avg(f).alias("mean"),
                F.stddev_samp(f).alias("std"),
                F.min(f).alias("min"),
                F.max(f).alias("max"),
            ).alias(f)
            for f in features
        ]
    )
    both = sums.join(quantiles(df, by, features, [0.5]), by) if by else attach(
        sums, quantiles(df, by, features, [0.5]), by
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"{f}.mean"),
            F.col(f"q_{f}")[0].alias("median"),
            *[F.col(f"{f}.{s}") for s in ("std", "min", "max")],
        )
        for f in features
    ]
    return both.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def group_mean(df: DataFrame, by: Sequence[str], column: str, output: str | None = None):
    """Mean per group: by (date, class), by two bins, by (sector, bin, bin)."""
    return df.groupBy(*by).agg(F.avg(column).alias(output or column))


def standard_error(std: Column, count: Column, conf: float = 1.0, of_median: bool = False) -> Column:
    """``conf * std / sqrt(n)``; of a median larger by ``sqrt(pi / 2)``."""
    err = F.lit(float(conf)) * std / F.sqrt(F.nullif(count, F.lit(0)).cast("double"))
    return err * F.lit(math.sqrt(math.pi / 2)) if of_median else err


def two_way_table(
    df: DataFrame,
    bin_x: str,
    bin_y: str,
    value: str,
    conf: float = 1.0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean, median, count and both standard errors per cell, with ``All`` margins.

    Margins come from the raw rows. Means and deviations are combined map-side by
    ``cube``; medians are exact order statistics of each cell, row, column and the whole.
    """
    rows = df.where(F.col(bin_x).isNotNull() & F.col(bin_y).isNotNull())
    x, y = F.col(bin_x).cast("string"), F.col(bin_y).cast("string")
    rows = rows.select(x.alias("bin_x"), y.alias("bin_y"), F.col(value).alias("_v"))
    all_ = F.lit("All")
    cells = rows.cube("bin_x", "bin_y").agg(
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("_std"),
        F.count("_v").alias("n"),
    )
    cells = cells.withColumns(
        {"bin_x": F.coalesce("bin_x", all_), "bin_y": F.coalesce("bin_y", all_)}
    )
    sides = F.array(
        *[
            F.struct(a.alias("bin_x"), b.alias("bin_y"))
            for a in (F.col("bin_x"), all_)
            for b in (F.col("bin_y"), all_)
        ]
    )
    spread = rows.select(F.explode(sides).alias("_s"), "_v").select("_s.*", "_v")
    medians = quantiles(spread, ["bin_x", "bin_y"], ["_v"], [0.5], hot_rows)
    # Both sides have one row per cell of the table.
    return cells.join(medians, ["bin_x", "bin_y"]).select(
        "bin_x",
        "bin_y",
        "mean",
        F.col("q__v")[0].alias("median"),
        "n",
        standard_error(F.col("_std"), F.col("n"), conf).alias("mean_err"),
        standard_error(F.col("_std"), F.col("n"), conf, of_median=True).alias("median_err"),
    )


def count_by(df: DataFrame, by: Sequence[str], output: str = "n") -> DataFrame:
    """Rows per group (contingency tables, sample counts per bin and month)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(output))


def mean_std_by(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean, sample std and count per group, e.g. per sector and two bins."""
    return df.groupBy(*by).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count(column).alias("n")
    )


def mean_median_by(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean and median per group, e.g. per period and bin."""
    mean = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))
    mid = quantiles(df, by, [column], [0.5])
    return mean.join(mid, list(by)).select(
        *by, "mean", F.col(f"q_{column}")[0].alias("median"), "n"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair, pairwise complete, in one aggregation."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def corr(a, b):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))

    wide = df.groupBy(*by).agg(
        *[corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    at = {}
    for i, (a, b) in enumerate(pairs):
        at[a, b] = at[b, a] = f"_{i}"
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(at[a, b]).alias("corr"))
        for a in columns
        for b in columns
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def factor_exposure(
    df: DataFrame, date: str, features: Sequence[str], n_classes: int, ties: Sequence[str]
) -> DataFrame:
    """Mean of each factor in its highest class minus its lowest, per month."""
    binned = discretize_by_month(df, features, n_classes, date, ties, suffix="bin")

    def mean_at(f, c):
        return F.avg(F.when(F.col(f"{f}_bin") == c, F.col(f)))

    return binned.groupBy(date).agg(
        *[(mean_at(f, n_classes - 1) - mean_at(f, 0)).alias(f) for f in features]
    )


def value_share(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of every value; the window sees one row per value only."""
    counts = count_by(df, [*keys, column])
    whole = F.sum("n").over(W.partitionBy(*(list(keys) or [F.lit(1)])))
    return counts.withColumn("share", F.col("n") / whole)


def distinct_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values of each column.

    Values are made distinct first (combined map-side), then counted, so that no task
    holds a column's values.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v"))
                for c in columns
            ]
        )
    )
    seen = df.select(pairs.alias("_p")).select("_p.*").where("v is not null").distinct()
    return count_by(seen, ["feature"], "n_distinct")


def tertile_boundary(
    df: DataFrame, variables: Sequence[str], suffix: str = "tertile", keys: Sequence[str] = ()
) -> DataFrame:
    """Lower and upper class boundary of each variable.

    Boundary i is the average of the (i+1)-th smallest class minimum and the i-th
    smallest class maximum. One row per class is all that is ordered.
    """
    rows = [
        F.struct(
            F.lit(v).alias("feature"),
            F.col(f"{v}_{suffix}").cast("string").alias("cls"),
            F.col(v).cast("double").alias("x"),
        )
        for v in variables
    ]
    long = df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")
    ends = (
        long.where("cls is not null and x is not null")
        .groupBy(*keys, "feature", "cls")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    # Two entries per class: as many as there are classes.
    both = ends.groupBy(*keys, "feature").agg(
        F.array_sort(F.collect_list("lo")).alias("lo"), F.array_sort(F.collect_list("hi")).alias("hi")
    )
    at = F.col
    return both.select(
        *keys,
        "feature",
        ((F.get("lo", F.size("lo") - 2) + at("hi")[0]) / 2).alias("lower_bound"),
        ((F.get("lo", F.size("lo") - 1) + F.get("hi", F.lit(1))) / 2).alias("upper_bound"),
    )


def expand_array(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """Long (ids, position, value) rows of a list that was stored as text."""
    parsed = F.from_json(
        F.translate(F.col(column), "'\"", ""), T.ArrayType(T.DoubleType())
    )
    return df.select(*ids, F.posexplode(parsed).alias("position", "value"))


def argmax_row(df: DataFrame, row_id: str, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Id of the largest metric, the lowest id on ties."""
    best = F.max_by(
        F.struct(row_id, metric), F.struct(F.col(metric), (-F.col(row_id)).alias("_low"))
    )
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, f"_b.{row_id}", f"_b.{metric}"
    )
