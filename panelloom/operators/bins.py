"""Quantile classes per month, and of the whole frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import attach
from .order_stats import HOT_ROWS, Target, largest_group, melt, quantiles, select_ranks


def class_names_of(names) -> list | None:
    """Class names in ascending order of value; of a mapping its keys."""
    return None if names is None else list(names)


def named(bin_: Column, names: Sequence | None) -> Column:
    """Translate a 0-based bin into the caller's class name."""
    if names is None:
        return bin_
    # get() rather than element_at(): a missing bin must give a missing name.
    return F.get(F.array(*[F.lit(n) for n in names]), bin_)


def _whole_part(a: Column, b: Column | int) -> Column:
    return ((a - a % b) / b).cast("long")


def fit_bins(
    df: DataFrame,
    variables: Sequence[str],
    n_classes: int,
    by: Sequence[str],
    ties: Sequence[str],
) -> DataFrame:
    """The last row (value and tie-break) of every class but the highest, per group.

    One row per group and variable; this is all that ``apply_bins`` needs, so the
    panel itself is never sorted or shuffled.
    """
    by, ties = list(by), list(ties)
    long = melt(df, [*by, *ties], variables)
    # The last rank of class i is 1 + (i + 1)(N - 1) div n: classes are right-closed
    # intervals of equal width in rank, computed in integers.
    targets = [
        Target((i + 1) / n_classes, lambda n, i=i: _whole_part((n - 1) * (i + 1), n_classes) + 1)
        for i in range(n_classes - 1)
    ]
    return select_ranks(long, [*by, "_variable"], "_value", targets, ties)


def _ranked_bin(variable: str, n_classes: int, by: Sequence[str], ties: Sequence[str]) -> Column:
    """The class by a window over the month: ranks split at the same integer limits."""
    x = F.nanvl(F.col(variable).cast("double"), F.lit(None).cast("double"))
    group = W.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(x.asc_nulls_last(), *ties)).cast("long")
    n = F.count(x).over(group)
    step = (rank - 1) * n_classes + n - 2
    upper = _whole_part(step, F.nullif(n - 1, F.lit(0)))
    return F.when(x.isNotNull(), F.greatest(upper, F.lit(1)) - 1).cast("int")


def _bin_of(x: Column, ties: Sequence[str], cuts: Column, n_classes: int) -> Column:
    here = F.struct((x.cast("double") + F.lit(0.0)).alias("x"), *[F.col(c) for c in ties])
    above = F.lit(0)
    for i in range(n_classes - 1):
        above = above + F.when(here > cuts[i], 1).otherwise(0)
    known = x.isNotNull() & ~F.isnan(x.cast("double")) & cuts.isNotNull()
    return F.when(known, above).cast("int")


def discretize_by_month(
    df: DataFrame,
    variables: Sequence[str],
    n_classes: int,
    month: str | Sequence[str],
    ties: Sequence[str],
    class_names=None,
    suffix: str = "discrete",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``<variable>_<suffix>``: the quantile class of each variable in its month.

    Rows are ranked by value, ties by the security key, and the ranks are cut into
    ``n_classes`` right-closed intervals of equal width; names are given in ascending
    order of value and a missing value has a missing class. ``month`` may list further
    group columns (model, fold, split).

    Months that one task can sort are ranked by a window. If any month is larger, only
    the class limits are looked for (``fit_bins``) and every row is compared with the
    limits of its month, so the panel is neither sorted nor shuffled.
    """
    by = [month] if isinstance(month, str) else list(month)
    variables, ties = list(variables), list(ties)
    names = class_names_of(class_names)
    if names is not None and len(names) != n_classes:
        raise ValueError("class_names must name every class")
    if largest_group(df, by) <= hot_rows:
        bins = {v: _ranked_bin(v, n_classes, by, ties) for v in variables}
        return df.withColumns({f"{v}_{suffix}": named(b, names) for v, b in bins.items()})
    fitted = fit_bins(df, variables, n_classes, by, ties)
    wide = fitted.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_variable") == v, F.col("cuts"))).alias(f"_cuts_{i}")
            for i, v in enumerate(variables)
        ]
    )
    out = attach(df, wide, by)
    added = {
        f"{v}_{suffix}": named(_bin_of(F.col(v), ties, F.col(f"_cuts_{i}"), n_classes), names)
        for i, v in enumerate(variables)
    }
    return out.withColumns(added).drop(*[f"_cuts_{i}" for i in range(len(variables))])


def rank_predictions(
    df: DataFrame,
    n_classes: int,
    month: str | Sequence[str],
    ties: Sequence[str],
    class_names=None,
    col_pred: str = "pred",
) -> DataFrame:
    """Quantile class of the prediction in its month, as ``<col_pred>_rank``."""
    return discretize_by_month(df, [col_pred], n_classes, month, ties, class_names, "rank")


def discretize_by_value(
    df: DataFrame,
    variable: str,
    n_classes: int,
    class_names=None,
    output: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Undated classes: right-closed intervals between the value quantiles."""
    by = list(by)
    probs = [(i + 1) / n_classes for i in range(n_classes - 1)]
    edges = quantiles(df, by, [variable], probs).select(*by, F.col(f"q_{variable}").alias("_edges"))
    out = attach(df, edges, by)
    x = F.col(variable)
    above = F.lit(0)
    for i in range(n_classes - 1):
        above = above + F.when(x > F.col("_edges")[i], 1).otherwise(0)
    bin_ = F.when(x.isNotNull() & ~F.isnan(x.cast("double")), above).cast("int")
    return out.withColumn(
        output or f"{variable}_discrete", named(bin_, class_names_of(class_names))
    ).drop("_edges")
