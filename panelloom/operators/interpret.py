"""Tables behind figures: histograms, boxes, fitted lines, surfaces, partial dependence."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import argmax_label
from ..session import attach
from .linear import linear_score
from .order_stats import quantiles
from .passes import add_up_array, matrix
from .trees import Tree, TreeModel, probabilities

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def histogram(
    df: DataFrame,
    column: str,
    n_bins: int,
    by: Sequence[str] = (),
    limits: tuple[float, float] | None = None,
    density: bool = False,
    common_over: Sequence[str] = (),
) -> DataFrame:
    """Counts in equal-width bins; the last bin is closed.

    The range is given or that of the data: of each ``by`` group without the
    ``common_over`` columns, so that hues of one figure share their bins. With
    ``density`` the bars of each group integrate to one.
    """
    by = list(by)
    frame_keys = [c for c in by if c not in common_over]
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    if limits is None:
        ends = rows.groupBy(*frame_keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        rows = attach(rows, ends, frame_keys)
    else:
        lo, hi = F.lit(float(limits[0])), F.lit(float(limits[1]))
        rows = rows.where(F.col("_v").between(lo, hi)).withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    spot = F.floor((F.col("_v") - F.col("_lo")) * n_bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    bin_ = F.least(F.coalesce(spot, F.lit(0)), F.lit(n_bins - 1)).cast("int")
    counts = rows.groupBy(*by, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first(width).alias("width")
    )
    out = counts.withColumn("left", F.col("_lo") + F.col("bin") * F.col("width")).drop("_lo")
    if not density:
        return out.drop("width")
    # At most n_bins rows per group.
    whole = F.sum("n").over(W.partitionBy(*(by or [F.lit(1)])))
    return out.withColumn("density", F.col("n") / F.nullif(whole * F.col("width"), F.lit(0.0))).drop("width")


def spread_marks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and mean +- 2 std of each column."""
    wide = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"{c}.m").alias("mean"),
            (F.col(f"{c}.m") - 2 * F.col(f"{c}.s")).alias("low"),
            (F.col(f"{c}.m") + 2 * F.col(f"{c}.s")).alias("high"),
        )
        for c in columns
    ]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def box_statistics(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Quartiles, mean, whiskers at the last data points within 1.5 ranges, outliers."""
    by = list(by)
    quart = quantiles(df, by, [column], [0.25, 0.5, 0.75])
    limits = quart.select(*by, *[F.col(f"q_{column}")[i].alias(f"q{i + 1}") for i in range(3)])
    rows = attach(df.where(F.col(column).isNotNull()).select(*by, column), limits, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(column)
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(*by).agg(
        *[F.first(q).alias(q) for q in ("q1", "q2", "q3")],
        F.avg(x).alias("mean"),
        F.min(F.when(inside, x)).alias("low_whisker"),
        F.max(F.when(inside, x)).alias("high_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    )


def fitted_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
    )


def residuals(df: DataFrame, label: str, pred: str = "pred") -> DataFrame:
    return df.where(F.col(label).isNotNull()).withColumn("residual", F.col(label) - F.col(pred))


def grid_axis(begin: float, end: float, step: float) -> int:
    """Number of points of the half-open axis begin, begin + step, ... < end."""
    return max(math.ceil((end - begin) / step), 0)


def mesh(
    spark: SparkSession, names: Sequence[str], limits: Sequence[tuple[float, float]], step: float
) -> DataFrame:
    """All points of a half-open grid, made by numbering them (no join)."""
    sizes = [grid_axis(lo, hi, step) for lo, hi in limits]
    points = spark.range(math.prod(sizes))
    columns, below = [], 1
    for name, (lo, _), size in zip(names, limits, sizes):
        spot = F.floor(F.col("id") / F.lit(below)) % size
        columns.append((F.lit(float(lo)) + spot * F.lit(float(step))).alias(name))
        below *= size
    return points.select(*columns)


def data_limits(df: DataFrame, features: Sequence[str]) -> list[tuple[float, float]]:
    """Range of each feature (one row to the driver)."""
    row = df.agg(*[f(c) for c in features for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(features))]


def surface(
    spark: SparkSession,
    coefs: DataFrame,
    features: Sequence[str],
    step: float,
    limits: Sequence[tuple[float, float]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Predictions of linear models on a grid of one or two features, per ``keys`` model.

    Every grid point is scored by all models at once: their coefficients travel as one
    aggregated row (one entry per parameter set).
    """
    keep = [*keys, "intercept", *[f"coef_{i}" for i in range(len(features))]]
    models = coefs.agg(F.collect_list(F.struct(*keep)).alias("_m"))
    grid = attach(mesh(spark, features, limits, step), models, [])
    scored = grid.select(*features, F.explode("_m").alias("_f")).select(*features, "_f.*")
    return scored.select(*keys, *features, linear_score(features).alias("pred"))


def percentile_grid(df: DataFrame, features: Sequence[str], resolution: int) -> DataFrame:
    """One row with the grid of each feature: its evenly spaced percentiles."""
    probs = [i / (resolution - 1) for i in range(resolution)]
    return quantiles(df, [], features, probs)


def partial_dependence(
    df: DataFrame,
    features: Sequence[str],
    interest: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    outputs: Sequence[str],
    resolution: int = 20,
) -> DataFrame:
    """Mean and std of the model's outputs with one or two features set to grid values.

    Each row is repeated per grid point on the map side and folded at once into the
    grid's partial aggregates, so what is shuffled is the grid.
    """
    grid = percentile_grid(df, interest, resolution)
    rows = attach(df.select(*features), grid, [])
    for i, f in enumerate(interest):
        rows = rows.withColumn(f"_g{i}", F.explode(F.array_distinct(f"q_{f}")))
    rows = rows.drop(*[f"q_{f}" for f in interest])
    marks = [F.col(f"_g{i}").alias(f) for i, f in enumerate(interest)]
    moved = rows.withColumns({f: F.col(f"_g{i}") for i, f in enumerate(interest)})
    scored = score(moved)
    return scored.groupBy(*marks).agg(
        *[F.avg(o).alias(f"mean_{o}") for o in outputs],
        *[F.stddev_pop(o).alias(f"std_{o}") for o in outputs],
    )


def tree_dependence(
    df: DataFrame, model: TreeModel, interest: Sequence[str], resolution: int = 20
) -> DataFrame:
    """``partial_dependence`` of a tree model's score (one per class: ``mean_score0``, ..).

    One pass counts, for every node of every tree, the rows that would reach it if splits on
    the factors of interest let everything through. A grid point then walks the trees: those
    splits go its way, and the other ones share it out by the counts. The means are exactly
    those of scoring the panel once per grid point.
    """
    inner = {model.features.index(f) for f in interest}
    flat = [(k, t) for group in model.trees for k, t in enumerate(group)]
    width = max([len(t.feature) for _, t in flat] + [1])

    def fold(total: np.ndarray, batch: pa.RecordBatch) -> None:
        rows = matrix(batch, model.features)
        total[-1, 0] += len(rows)
        for i, (_, tree) in enumerate(flat):
            total[i, : len(tree.feature)] += reaching(tree, rows, inner)

    columns = [F.col(c).cast("double").alias(c) for c in model.features]
    count = add_up_array(df.select(*columns), (len(flat) + 1, width), fold)
    n = max(count[-1, 0], 1.0)
    grid = percentile_grid(df, interest, resolution).first()  # ``resolution`` numbers per factor
    axes = [sorted({v for v in grid[f"q_{f}"] or [] if v is not None}) for f in interest]
    points = []
    for spot in itertools.product(*axes):
        value = dict(zip((model.features.index(f) for f in interest), spot))
        scores = [float(model.params.start)] * model.params.outputs
        for i, (k, tree) in enumerate(flat):
            scores[k] += sum(tree.value[leaf] * count[i, leaf] for leaf in leaves_at(tree, value)) / n
        points.append((*map(float, spot), *map(float, scores)))
    names = [*interest, *[f"mean_score{k}" for k in range(model.params.outputs)]]
    return df.sparkSession.createDataFrame(points, ", ".join(f"`{c}` double" for c in names))


def reaching(tree: Tree, rows: np.ndarray, free: set[int]) -> np.ndarray:
    """Rows that reach each node if splits on the ``free`` factors send them both ways."""
    here = {0: np.ones(len(rows), bool)}
    out = np.zeros(len(tree.feature))
    for node in range(len(tree.feature)):
        if node not in here:
            continue
        held, f = here.pop(node), tree.feature[node]
        out[node] = held.sum()
        if f < 0:
            continue
        if f in free:
            left = right = held
        else:
            x = rows[:, f]
            goes = np.where(np.isnan(x), tree.missing_left[node], x <= tree.cut[node])
            left, right = held & goes, held & ~goes
        here[2 * node + 1], here[2 * node + 2] = left, right
    return out


def leaves_at(tree: Tree, value: dict[int, float], node: int = 0) -> list[int]:
    """Leaves that a grid point can reach, whatever the other factors are."""
    f = tree.feature[node]
    if f < 0:
        return [node]
    if f in value:
        return leaves_at(tree, value, 2 * node + (1 if value[f] <= tree.cut[node] else 2))
    return leaves_at(tree, value, 2 * node + 1) + leaves_at(tree, value, 2 * node + 2)


def tree_class_dependence(
    df: DataFrame, model: TreeModel, interest: Sequence[str], resolution: int = 20
) -> DataFrame:
    """Mean and std of each class's probability (``mean_p0``, ``std_p0``, ..) on the grid.

    Probabilities do not add up over trees, so rows are not summed per node. They differ only in
    the bins of the other factors that the trees tell apart: the panel is counted once by
    these, and tasks score the counted combinations, not the rows, at all grid points.
    """
    classes = model.params.outputs
    grid = percentile_grid(df, interest, resolution).first()
    axes = [sorted({v for v in grid[f"q_{f}"] or [] if v is not None}) for f in interest]
    spots = np.array(list(itertools.product(*axes)), float).reshape(-1, len(interest))
    at = [model.features.index(f) for f in interest]
    rest = [i for i in range(len(model.features)) if i not in at]
    bins, middles = [], []
    for i in rest:
        cuts = sorted({float(c) for g in model.trees for t in g for c in t.cut[t.feature == i] if np.isfinite(c)})
        x = F.nanvl(F.col(model.features[i]).cast("double"), F.lit(None).cast("double"))
        bin_ = F.lit(0)
        for j, c in enumerate(cuts):
            bin_ = F.when(x > F.lit(c), j + 1).otherwise(bin_)
        bins.append(F.when(x.isNotNull(), bin_).alias(f"b{i}"))
        # A number inside each bin: the upper cut, and something above the last one.
        middles.append(np.array([*cuts, (cuts[-1] + 1 + abs(cuts[-1])) if cuts else 0.0]))
    counted = df.groupBy(*bins).agg(F.count(F.lit(1)).cast("double").alias("n")) if bins else df.agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    names = [f"b{i}" for i in rest]

    def fold(total: np.ndarray, batch: pa.RecordBatch) -> None:
        held = matrix(batch, [*names, "n"])
        rows = np.empty((len(held), len(model.features)))
        for j, i in enumerate(rest):
            b = held[:, j]
            rows[:, i] = np.where(np.isnan(b), np.nan, middles[j][np.nan_to_num(b).astype(int)])
        for g, spot in enumerate(spots):
            rows[:, at] = spot
            p = probabilities(model.raw(rows))
            total[g, :, 0] += held[:, -1] @ p
            total[g, :, 1] += held[:, -1] @ (p * p)
        total[-1, 0, 0] += held[:, -1].sum()

    total = add_up_array(counted, (len(spots) + 1, classes, 2), fold)
    mean, square = (total[:-1, :, i] / max(total[-1, 0, 0], 1.0) for i in (0, 1))
    std = np.sqrt(np.maximum(square - mean * mean, 0))
    points = [(*map(float, s), *map(float, m), *map(float, d)) for s, m, d in zip(spots, mean, std)]
    out = [*interest, *[f"mean_p{k}" for k in range(classes)], *[f"std_p{k}" for k in range(classes)]]
    return df.sparkSession.createDataFrame(points, ", ".join(f"`{c}` double" for c in out))


def class_map(dependence: DataFrame, features: Sequence[str], outputs: Sequence[str], labels: Sequence):
    """Most probable class at each grid point of a two-way partial dependence."""
    scores = F.array(*[F.col(f"mean_{o}") for o in outputs])
    return dependence.select(*features, argmax_label(scores, labels).alias("label"))


def half_range(high: Column, low: Column) -> Column:
    """Error bar of a daily series."""
    return (high - low) / 2
