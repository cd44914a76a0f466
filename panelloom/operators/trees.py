"""Gradient-boosted trees from distributed histograms.

Factors are cut once at exact quantiles and the cut panel is written. From then on a level of
a tree is one pass: tasks add gradients and curvatures into (node, factor, bin) cells, Spark
adds the tasks' cells, and the driver compares the cuts of a few nodes. All classes of a
model and all models that are fitted together (folds, parameter sets, months of a
walk-forward) share each pass, so the number of passes follows rounds and depth only.

A split sends rows without the factor to the side that gains more, so every row is scored.
Objectives that grow linearly (``mape``, ``log_abs``) have no curvature to step by: their
leaves are weighted medians of the residuals, found by radix selection (a pass fixes twelve
bits of the answer for all leaves). Objectives without a convex loss use the curvature of a
bound above it, and every round ends with a line search, so no round raises the loss.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .order_stats import quantiles
from .passes import add_up, add_up_array, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Floors of the reference's formulas.
MAPE_FLOOR = 1e-7
LOG_FLOOR = -1 + 1e-6
# A split must lower the loss by more than this.
LEAST_GAIN = 1e-6
# Gains this close (relatively) are ties; the first factor and cut win.
TIE = 1e-9
# Rounds after which the scores are written beside the rows instead of walked again.
ROUNDS_KEPT = 10
# Cells of one pass; more models than fit are taken in turns.
CELLS = 4_000_000
# Shares of a step that the line search compares, best loss first kept.
STEPS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.0)
RADIX_BITS = 12

ABSOLUTE = ("mape", "log_abs")
PLAIN = ("mse", "softmax", "logistic")


@dataclass(frozen=True)
class TreeParams:
    """``objective``: mse, squared_log, log_square, mape, log_abs, softmax or logistic.

    ``null_unseen``: a row without a factor that no row of the fit lacked has no prediction;
    else it goes right wherever that factor decides.
    """

    objective: str = "mse"
    rounds: int = 50
    eta: float = 0.3
    max_depth: int = 3
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    n_classes: int = 1
    start: float = 0.0
    max_bins: int = 64
    seed: int = 0
    null_unseen: bool = False

    @property
    def outputs(self) -> int:
        return self.n_classes if self.objective == "softmax" else 1


@dataclass
class Tree:
    """A binary tree in heap order: node i has the children 2 i + 1 and 2 i + 2.

    ``feature`` is -1 at leaves; rows with ``bin <= at`` (``x <= cut``) go left, rows without
    the factor as ``missing_left`` says. ``value`` is a leaf's step.
    """

    feature: np.ndarray
    at: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(
            np.full(n, -1), np.zeros(n, np.int64), np.full(n, np.nan), np.zeros(n, bool), np.zeros(n), np.zeros(n),
            np.zeros(n),
        )

    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def walk(self, rows: np.ndarray, missing: Callable[[np.ndarray], np.ndarray], limit: np.ndarray) -> np.ndarray:
        """The leaf (or lowest node so far) of every row; ``limit`` is ``at`` or ``cut``."""
        node = np.zeros(len(rows), np.int64)
        every = np.arange(len(rows))
        for _ in range(self.depth()):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            x = rows[every, np.maximum(f, 0)]
            left = np.where(missing(x), self.missing_left[node], x <= limit[node])
            node = np.where(inner, 2 * node + 2 - left, node)
        return node

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.value[self.walk(rows, np.isnan, self.cut)]


def is_missing_bin(b: np.ndarray) -> np.ndarray:
    return b < 0


def binned_leaf(tree: Tree, bins: np.ndarray) -> np.ndarray:
    return tree.walk(bins, is_missing_bin, tree.at)


def slopes(objective: str, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and a positive curvature, (rows, outputs).

    Where the loss is not convex, or has no curvature, it is that of a function above the loss
    that touches it at the score.
    """
    if objective == "softmax":
        p = probabilities(f)
        hit = np.zeros_like(p)
        hit[np.arange(len(y)), y.astype(np.int64)] = 1
        return p - hit, np.maximum(2 * p * (1 - p), 1e-16)
    gap = f - y[:, None]
    if objective == "logistic":
        p = 1 / (1 + np.exp(-f))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    if objective == "mse":
        return gap, np.ones_like(gap)
    if objective == "squared_log":
        p = np.where(f < -1, LOG_FLOOR, f) + 1
        return (np.log(p) - np.log1p(y)[:, None]) / p, 1 / p**2
    if objective == "log_square":
        w = 2 / (gap * gap + 1)
        return w * gap, w
    # The parabola above w |gap| that touches it here; near zero it stays that of a tenth of the
    # residual's own scale, else single rows that fit would hide all others.
    w = residual_weight(objective, y[:, None], gap)
    scale = np.maximum(np.abs(y[:, None]), MAPE_FLOOR) if objective == "mape" else 1.0
    return w * np.sign(gap), w / np.maximum(np.abs(gap), 0.1 * scale)


def residual_weight(objective: str, y: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Weight of the absolute residual that bounds an absolute loss from above."""
    if objective == "mape":
        return np.broadcast_to(100 / np.maximum(np.abs(y), MAPE_FLOOR), gap.shape)
    if objective == "log_abs":
        return 1 / (np.abs(gap) + 1)
    raise ValueError(f"unknown objective {objective}")


def row_losses(objective: str, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    gap = f[:, 0] - y
    if objective == "mse":
        return gap * gap / 2
    if objective == "squared_log":
        p = np.where(f[:, 0] < -1, LOG_FLOOR, f[:, 0])
        return (np.log1p(p) - np.log1p(y)) ** 2 / 2
    if objective == "log_square":
        return np.log1p(gap * gap)
    if objective == "mape":
        return 100 * np.abs(gap) / np.maximum(np.abs(y), MAPE_FLOOR)
    if objective == "log_abs":
        return np.log1p(np.abs(gap))
    if objective == "logistic":
        return np.logaddexp(0, f[:, 0]) - y * f[:, 0]
    p = probabilities(f)
    return -np.log(np.maximum(p[np.arange(len(y)), y.astype(np.int64)], 1e-300))


def probabilities(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ---- fitted models -----------------------------------------------------------------------------


@dataclass
class TreeModel:
    """A fitted model: per round one tree per output. ``losses`` has the mean loss of the rows
    after every round whose objective is line-searched; ``unseen`` the factors that no row
    of the fit lacked."""

    features: list[str]
    params: TreeParams
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    unseen: list[str] = field(default_factory=list)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Scores of a matrix of factors (NaN: missing), (rows, outputs)."""
        out = np.full((len(rows), self.params.outputs), float(self.params.start))
        for group in self.trees:
            for k, tree in enumerate(group):
                out[:, k] += tree.raw(rows)
        return out

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        """Every row scored. Classifiers also add ``probability``, an array by class."""
        scores = score_column([self])(*[F.col(c).cast("double") for c in self.features])
        if self.params.objective == "mse" or self.params.objective not in PLAIN:
            known = F.lit(True)
            for c in self.unseen if self.params.null_unseen else ():
                known = known & F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).isNotNull()
            return df.withColumn(output, F.when(known, scores[0]))
        if self.params.objective == "logistic":
            p = 1 / (1 + F.exp(-scores[0]))
            out = df.withColumn("_s", F.array(1 - p, p))
        else:
            exp = F.transform(scores, lambda v: F.exp(v))
            out = df.withColumn("_s", exp)
        total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("probability", F.transform("_s", lambda v: v / total)).drop("_s")
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn(output, best.cast("double"))

    def rows(self) -> list[tuple]:
        """(round, output, node, factor, cut, missing_left, value, gain, cover) of all nodes in use."""
        out = []
        for r, group in enumerate(self.trees):
            for k, t in enumerate(group):
                for i in range(len(t.feature)):
                    if i and t.feature[(i - 1) // 2] < 0:
                        continue
                    inner = t.feature[i] >= 0
                    out.append((
                        r, k, i, self.features[t.feature[i]] if inner else None, float(t.cut[i]) if inner else None,
                        bool(t.missing_left[i]) if inner else None, None if inner else float(t.value[i]),
                        float(t.gain[i]) if inner else None, float(t.cover[i]),
                    ))
        return out

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as a table and a line of JSON in ``metadata``, as Spark's own models have."""
        path = path.rstrip("/")
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        text = json.dumps({"class": CLASS_NAME, "features": self.features, "params": asdict(self.params), "unseen": self.unseen})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


CLASS_NAME = "panelloom.TreeModel"
NODE_SCHEMA = (
    "round int, output int, node int, factor string, cut double, missing_left boolean, value double, gain double,"
    " cover double"
)


def load_trees(spark: SparkSession, path: str, about: dict) -> TreeModel:
    model = TreeModel(about["features"], TreeParams(**about["params"]), unseen=about["unseen"])
    number = {f: i for i, f in enumerate(model.features)}
    nodes = spark.read.parquet(f"{path.rstrip('/')}/nodes").orderBy("round", "output", "node").collect()
    for r in nodes:  # a model's nodes, not data
        if r["round"] == len(model.trees):
            model.trees.append([Tree.empty(model.params.max_depth) for _ in range(model.params.outputs)])
        t, i = model.trees[r["round"]][r["output"]], r["node"]
        t.cover[i] = r["cover"]
        if r["factor"] is None:
            t.value[i] = r["value"]
        else:
            t.feature[i], t.cut[i], t.missing_left[i], t.gain[i] = number[r["factor"]], r["cut"], r["missing_left"], r["gain"]
    return model


def classes_of(model: TreeModel, raw: np.ndarray) -> np.ndarray:
    """What ``transform`` predicts, from a model's scores."""
    if model.params.objective == "softmax":
        return raw.argmax(axis=1).astype(float)
    return (raw[:, 0] > 0).astype(float) if model.params.objective == "logistic" else raw[:, 0]


def prediction_column(models: Sequence[TreeModel], features: Sequence[str]) -> Column:
    """The array of the predictions of several models, for every row."""
    models = list(models)

    def score(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(list(np.stack([classes_of(m, m.raw(rows)) for m in models], axis=1)))

    return F.pandas_udf(score, "array<double>")(*[F.col(c).cast("double") for c in features])


def prediction_of(models: Sequence[TreeModel], features: Sequence[str], which: Column) -> Column:
    """The prediction of model number ``which`` of each row; null without a number."""
    models = list(models)

    def score(which: pd.Series, *columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        number = which.to_numpy(dtype=float)
        out = np.full(len(rows), np.nan)
        for i in np.unique(number[~np.isnan(number)]).astype(int):
            own = number == i
            out[own] = classes_of(models[i], models[i].raw(rows[own]))
        return pd.Series(out)

    found = F.pandas_udf(score, "double")(which.cast("double"), *[F.col(c).cast("double") for c in features])
    return F.nanvl(found, F.lit(None).cast("double"))


def score_column(models: Sequence[TreeModel]):
    """A function of factor columns: the array of all outputs of all models."""
    models = list(models)

    def score(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(list(np.concatenate([m.raw(rows) for m in models], axis=1)))

    return F.pandas_udf(score, "array<double>")


# ---- the binned panel --------------------------------------------------------------------------


@dataclass
class Binned:
    """The written panel: ``b0..`` bins (-1: missing), ``y``, date number ``t``, hash ``u``, scores ``f``."""

    table: DataFrame
    path: str
    features: list[str]
    cuts: list[np.ndarray]

    @property
    def columns(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.features))]

    def drop(self) -> None:
        drop_table(self.table.sparkSession, self.path)


def quantile_cuts(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Distinct inner quantiles of each factor (one row to the driver)."""
    row = quantiles(df, [], list(features), [i / max_bins for i in range(1, max_bins)]).first()
    out = []
    for c in features:
        found = row[f"q_{c}"] if row is not None else None
        out.append(np.unique(np.array(found or [], float)))
    return out


def bin_panel(
    df: DataFrame, features: Sequence[str], label: str, max_bins: int, when: Column | None = None,
    key: Sequence[str] = (), cuts: list[np.ndarray] | None = None, samples: dict[str, Column] | None = None,
) -> Binned:
    """Cut the labelled rows. NaN counts as missing; infinities fall into the outer bins.

    ``when`` numbers the dates, and ``samples`` names boolean columns, that models may restrict
    their rows to.
    """
    features = list(features)
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features]
    y = F.nanvl(F.col(label).cast("double"), F.lit(None).cast("double"))
    when = F.lit(0) if when is None else when
    samples = samples or {}
    rows = df.select(
        *clean, y.alias("_y"), when.cast("int").alias("_t"), F.xxhash64(*(key or [*features, label])).alias("_u"),
        *[c.alias(n) for n, c in samples.items()],
    ).where("_y IS NOT NULL")
    if cuts is None:
        cuts = quantile_cuts(rows, features, max_bins)
    names = list(samples)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, features)
            out = []
            for i, cut in enumerate(cuts):
                found = np.searchsorted(cut, x[:, i], side="left")
                out.append(pa.array(np.where(np.isnan(x[:, i]), -1, found).astype(np.int16)))
            rest = [batch.column(len(features) + i) for i in range(3 + len(names))]
            yield pa.RecordBatch.from_arrays(
                [*out, *rest], names=[*[f"b{i}" for i in range(len(cuts))], "y", "t", "u", *names]
            )

    fields = [f"b{i} short" for i in range(len(features))] + ["y double", "t int", "u long"]
    fields += [f"{n} boolean" for n in names]
    table, path = write_table(rows.mapInArrow(task, ", ".join(fields)), "bins")
    return Binned(table, path, features, cuts)


# ---- fitting -----------------------------------------------------------------------------------


@dataclass
class Job:
    """One model of a joint fit: its rows are those of ``dates`` (None: all) and ``sample``."""

    params: TreeParams
    dates: frozenset[int] | None = None
    sample: str | None = None


def mixed(u: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number in [0, 1) per row hash and salt."""
    x = u.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


@dataclass
class Rows:
    """A batch of the binned panel."""

    bins: np.ndarray
    y: np.ndarray
    t: np.ndarray
    u: np.ndarray
    flags: dict[str, np.ndarray]
    kept: np.ndarray | None


def read_rows(batch: pa.RecordBatch, n: int) -> Rows:
    names = batch.schema.names
    bins = np.stack([batch.column(i).to_numpy() for i in range(n)], axis=1)
    y, t, u = (batch.column(n + i).to_numpy() for i in range(3))
    flags = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names) if i >= n + 3 and c != "f"}
    kept = None
    if "f" in names:
        kept = batch.column(names.index("f")).flatten().to_numpy().reshape(batch.num_rows, -1)
    return Rows(bins, y, t, u, flags, kept)


@dataclass
class Fit:
    """Models under way. ``first`` is the round from which trees are not yet in the kept scores."""

    data: Binned
    jobs: list[Job]
    trees: list[list[list[Tree]]]
    losses: list[list[float]]
    first: int = 0
    unseen: dict[int, list[str]] = field(default_factory=dict)

    def columns(self) -> list[int]:
        """Where the outputs of each job start among the kept scores."""
        return np.cumsum([0, *[j.params.outputs for j in self.jobs]]).tolist()

    def plan(self) -> tuple:
        """What a task needs to score rows: plain values, no DataFrames."""
        late = [t[self.first :] for t in self.trees]
        return self.jobs, self.columns(), late, len(self.data.features)


def chosen_rows(job: Job, rows: Rows, round_: int | None) -> np.ndarray:
    """Rows a model learns from; with a round, also its subsample."""
    use = np.ones(len(rows.y), bool)
    if job.dates is not None:
        use &= np.isin(rows.t, np.fromiter(job.dates, np.int64, len(job.dates)))
    if job.sample is not None:
        use &= rows.flags[job.sample]
    if round_ is not None and job.params.subsample < 1:
        use &= mixed(rows.u, job.params.seed * 1_000_003 + round_ + 1) < job.params.subsample
    return np.flatnonzero(use)


def scores_of(plan: tuple, a: int, rows: Rows, at: np.ndarray) -> np.ndarray:
    jobs, columns, late, _ = plan
    k = jobs[a].params.outputs
    if rows.kept is None:
        out = np.full((len(at), k), float(jobs[a].params.start))
    else:
        out = rows.kept[at, columns[a] : columns[a] + k].copy()
    for group in late[a]:
        for j, tree in enumerate(group):
            out[:, j] += tree.value[binned_leaf(tree, rows.bins[at])]
    return out


def histograms(fit: Fit, active: list[int], fresh: dict[int, list[Tree]], level: int, round_: int, n_bins: int) -> np.ndarray:
    """(job, output, node of the level, factor, bin, [g, h, n]) sums; the last bin is the missing one."""
    plan, p, first = fit.plan(), len(fit.data.features), 2**level - 1
    outputs = max(fit.jobs[a].params.outputs for a in active)
    shape = (len(active), outputs, 2**level, p, n_bins, 3)

    def fold(total: np.ndarray, batch: pa.RecordBatch) -> None:
        rows = read_rows(batch, p)
        for i, a in enumerate(active):
            at = chosen_rows(plan[0][a], rows, round_)
            if not len(at):
                continue
            g, h = slopes(plan[0][a].params.objective, rows.y[at], scores_of(plan, a, rows, at))
            for k, tree in enumerate(fresh[a]):
                node = binned_leaf(tree, rows.bins[at]) - first
                open_ = node >= 0
                node, own = node[open_], at[open_]
                for f in range(p):
                    b = rows.bins[own, f]
                    cell = node * n_bins + np.where(b < 0, n_bins - 1, b)
                    for v, weight in enumerate((g[open_, k], h[open_, k], None)):
                        found = np.bincount(cell, weight, minlength=2**level * n_bins)
                        total[i, k, :, f, :, v] += found.reshape(2**level, n_bins)

    return add_up_array(fit.data.table, shape, fold)


def best_splits(cells: np.ndarray, cuts: list[np.ndarray], params: TreeParams) -> list[tuple | None]:
    """Per node (gain, factor, bin, missing_left, left sums, right sums), or None.

    ``cells`` is (node, factor, bin, [g, h, n]). The cut behind the last bin parts the rows that
    have the factor from those that do not.
    """
    out = []
    lam = params.reg_lambda

    def gain(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + lam, 1e-300)

    n_bins = cells.shape[2]
    last = np.array([len(c) for c in cuts])
    for node in range(len(cells)):
        own = cells[node]
        total = own[0].sum(axis=0)
        if total[2] == 0:
            out.append(None)
            continue
        below = np.cumsum(own[:, :-1], axis=1)  # (factor, cut, sums) of the rows that have it
        missing = own[:, -1:, :]
        left = np.stack([below, below + missing], axis=1)  # missing right, missing left
        right = total - left
        ok = (left[..., 2] > 0.5) & (right[..., 2] > 0.5)
        ok &= (left[..., 1] >= params.min_child_weight) & (right[..., 1] >= params.min_child_weight)
        at = np.arange(n_bins - 1)
        ok[:, 0] &= at <= last[:, None]
        ok[:, 1] &= at < last[:, None]
        won = np.where(ok, gain(left) + gain(right) - gain(total), -np.inf)
        top = won.max()
        if not top > LEAST_GAIN or top < params.gamma:
            out.append(None)
            continue
        f, side, b = np.unravel_index(int(np.argmax(won.reshape(-1) >= top - TIE * abs(top))), won.shape)
        out.append((won[f, side, b], f, b, bool(side), left[f, side, b], right[f, side, b]))
    return out


def grow(fit: Fit, active: list[int], round_: int) -> dict[int, list[Tree]]:
    """One new tree per job and output, level by level."""
    cuts = fit.data.cuts
    n_bins = max([len(c) for c in cuts] + [0]) + 2
    fresh = {a: [Tree.empty(fit.jobs[a].params.max_depth) for _ in range(fit.jobs[a].params.outputs)] for a in active}
    growing = list(active)
    level = 0
    while growing:
        size = max(fit.jobs[a].params.outputs for a in growing) * 2**level * len(cuts) * n_bins * 3
        turn = max(1, CELLS // size)
        still = []
        for i in range(0, len(growing), turn):
            part = growing[i : i + turn]
            cells = histograms(fit, part, fresh, level, round_, n_bins)
            for j, a in enumerate(part):
                if level == 0 and round_ == 0:
                    lacking = cells[j, 0, 0, :, -1, 2]
                    fit.unseen[a] = [c for c, n in zip(fit.data.features, lacking) if n == 0]
                if split_level(cells[j], fresh[a], fit.jobs[a].params, cuts, level) and level + 1 < fit.jobs[a].params.max_depth:
                    still.append(a)
        growing = still
        level += 1
    return fresh


def split_level(cells: np.ndarray, trees: list[Tree], params: TreeParams, cuts: list[np.ndarray], level: int) -> bool:
    """Enter the best splits of a level; whether there was one."""
    found = False
    for k, tree in enumerate(trees):
        for i, split in enumerate(best_splits(cells[k], cuts, params)):
            node = 2**level - 1 + i
            if level == 0:
                total = cells[k, 0, 0].sum(axis=0)
                tree.value[0], tree.cover[0] = leaf_step(total, params), total[2]
            if split is None:
                continue
            found = True
            tree.gain[node], f, b, tree.missing_left[node], left, right = split
            tree.feature[node], tree.at[node] = f, b
            tree.cut[node] = cuts[f][b] if b < len(cuts[f]) else np.inf
            for child, sums in ((2 * node + 1, left), (2 * node + 2, right)):
                tree.value[child], tree.cover[child] = leaf_step(sums, params), sums[2]
    return found


def leaf_step(sums: np.ndarray, params: TreeParams) -> float:
    return -params.eta * sums[0] / max(sums[1] + params.reg_lambda, 1e-300) if sums[2] else 0.0


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: int) -> float:
    bits = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def median_leaves(fit: Fit, active: list[int], fresh: dict[int, list[Tree]]) -> None:
    """Set the leaves of absolute objectives to weighted medians of the residuals.

    The lower weighted median is the least residual whose running weight reaches half of its
    leaf's. Each pass counts the weight of 2^12 ranges inside what is still open, for all leaves
    of all models; after 64 bits, or when a range holds one value, it is found.
    """
    plan, p = fit.plan(), len(fit.data.features)
    open_: dict[tuple[int, int], tuple[int, int, float | None]] = {}  # (job, leaf): (bits fixed, prefix, weight wanted)
    for a in active:
        for leaf in range(len(fresh[a][0].feature)):
            if fresh[a][0].cover[leaf] and fresh[a][0].feature[leaf] < 0:
                open_[a, leaf] = (0, 0, None)
    while open_:
        wanted = dict(open_)
        jobs = sorted({a for a, _ in wanted})
        number = {key: i for i, key in enumerate(sorted(wanted))}

        def step(state: dict, batch: pa.RecordBatch) -> None:
            rows = read_rows(batch, p)
            for a in jobs:
                job = plan[0][a]
                at = chosen_rows(job, rows, None)
                if not len(at):
                    continue
                gap = scores_of(plan, a, rows, at)[:, 0] - rows.y[at]
                weight = residual_weight(job.params.objective, rows.y[at], gap)
                bits = ordered_bits(-gap)
                leaf = binned_leaf(fresh[a][0], rows.bins[at])
                for here in np.unique(leaf):
                    if (a, here) not in wanted:
                        continue
                    fixed, prefix, _ = wanted[a, here]
                    own = leaf == here
                    if fixed:
                        own &= bits >> np.uint64(64 - fixed) == np.uint64(prefix)
                    width = min(RADIX_BITS, 64 - fixed)
                    part = bits[own] >> np.uint64(64 - fixed - width) & np.uint64((1 << width) - 1)
                    # Whether a range holds one value: sums of weighted low halves cannot tell, extremes can.
                    order = np.argsort(bits[own], kind="stable")
                    value, share, w = bits[own][order], part[order], weight[own][order]
                    edge = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]) if len(share) else []
                    for i, j in zip(edge, [*edge[1:], len(share)]):
                        cell = number[a, here] << RADIX_BITS | int(share[i])
                        low, high, sum_ = state.get(cell, (value[i], value[i], 0.0))
                        state[cell] = (min(low, value[i]), max(high, value[j - 1]), sum_ + w[i:j].sum())

        found = extremes(fit.data.table, step)
        for (a, leaf), i in number.items():
            fixed, prefix, target = wanted[a, leaf]
            own = sorted((c & ((1 << RADIX_BITS) - 1), v) for c, v in found.items() if c >> RADIX_BITS == i)
            if not own:
                del open_[a, leaf]
                continue
            if target is None:
                target = sum(v[2] for _, v in own) / 2
            for n, (part, (low, high, weight)) in enumerate(own):
                if weight >= target or n == len(own) - 1:
                    break
                target -= weight
            width = min(RADIX_BITS, 64 - fixed)
            if low == high or fixed + width == 64:
                fresh[a][0].value[leaf] = fit.jobs[a].params.eta * from_bits(low)
                del open_[a, leaf]
            else:
                open_[a, leaf] = (fixed + width, prefix << width | part, target)


def extremes(table: DataFrame, step: Callable[[dict, pa.RecordBatch], None]) -> dict[int, tuple[int, int, float]]:
    """Least and greatest bits and total weight per cell, over all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[int, int, float]] = {}
        for batch in batches:
            step(state, batch)
        low, high = (np.array([v[i] for v in state.values()], np.uint64) ^ np.uint64(1 << 63) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(state), pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
             pa.array([float(v[2]) for v in state.values()], pa.float64())],
            names=["cell", "low", "high", "weight"],
        )

    parts = table.mapInArrow(task, "cell long, low long, high long, weight double")
    summed = parts.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("weight").alias("w"))
    shift = 1 << 63
    return {r["cell"]: (r["low"] + shift, r["high"] + shift, r["w"]) for r in summed.collect()}


def line_search(fit: Fit, active: list[int], fresh: dict[int, list[Tree]]) -> None:
    """Shrink each job's new trees to the step of the least total loss."""
    plan, p = fit.plan(), len(fit.data.features)

    def fold(total: np.ndarray, batch: pa.RecordBatch) -> None:
        rows = read_rows(batch, p)
        for i, a in enumerate(active):
            at = chosen_rows(plan[0][a], rows, None)
            if not len(at):
                continue
            f = scores_of(plan, a, rows, at)
            move = np.stack([t.value[binned_leaf(t, rows.bins[at])] for t in fresh[a]], axis=1)
            for s, share in enumerate(STEPS):
                total[i, s] += row_losses(plan[0][a].params.objective, rows.y[at], f + share * move).sum()
            total[i, len(STEPS)] += len(at)

    total = add_up_array(fit.data.table, (len(active), len(STEPS) + 1), fold)
    for i, a in enumerate(active):
        best = int(np.argmin(total[i, : len(STEPS)]))
        for tree in fresh[a]:
            tree.value *= STEPS[best]
        fit.losses[a].append(float(total[i, best] / max(total[i, -1], 1)))


def keep_scores(fit: Fit) -> None:
    """Write the scores of all jobs beside the rows; later passes walk newer trees only."""
    plan, p = fit.plan(), len(fit.data.features)
    names = [c for c in fit.data.table.columns if c != "f"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = read_rows(batch, p)
            every = np.arange(batch.num_rows)
            f = np.concatenate([scores_of(plan, a, rows, every) for a in range(len(plan[0]))], axis=1)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * f.shape[1]
            scores = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.reshape(-1)))
            held = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*held, scores], names=[*names, "f"])

    table = fit.data.table
    fields = [f"{c.name} {c.dataType.simpleString()}" for c in table.schema if c.name != "f"]
    written, path = write_table(table.mapInArrow(task, ", ".join([*fields, "f array<double>"])), "bins")
    drop_table(table.sparkSession, fit.data.path)
    fit.data = Binned(written, path, fit.data.features, fit.data.cuts)
    fit.first = len(fit.trees[0])


def fit_jobs(data: Binned, jobs: Sequence[Job]) -> list[TreeModel]:
    """Fit all jobs together on one binned panel, which is dropped at the end."""
    jobs = list(jobs)
    fit = Fit(data, jobs, [[] for _ in jobs], [[] for _ in jobs])
    rounds = max(j.params.rounds for j in jobs)
    for r in range(rounds):
        active = [a for a, j in enumerate(jobs) if r < j.params.rounds]
        fresh = grow(fit, active, r)
        absolute = [a for a in active if jobs[a].params.objective in ABSOLUTE]
        if absolute:
            median_leaves(fit, absolute, fresh)
        searched = [a for a in active if jobs[a].params.objective not in PLAIN]
        if searched:
            line_search(fit, searched, fresh)
        for a in range(len(jobs)):  # a finished job gets trees without a step, so rounds stay aligned
            fit.trees[a].append(fresh[a] if a in fresh else [Tree.empty(0) for _ in range(jobs[a].params.outputs)])
        if (r + 1) % ROUNDS_KEPT == 0 and r + 1 < rounds:
            keep_scores(fit)
    fit.data.drop()
    return [
        TreeModel(data.features, j.params, fit.trees[a][: j.params.rounds], fit.losses[a], fit.unseen.get(a, []))
        for a, j in enumerate(jobs)
    ]


class BoostedTrees:
    """Estimator: ``fit(df)`` gives a TreeModel. Rows without a label are left out of the fit.

    ``key`` names the columns whose hash decides on subsamples (default: factors and label).
    """

    def __init__(self, features: Sequence[str], label: str, params: TreeParams, key: Sequence[str] = ()):
        self.features, self.label, self.params, self.key = list(features), label, params, list(key)

    def set_params(self, **changes) -> "BoostedTrees":
        """The same estimator with other parameters."""
        return BoostedTrees(self.features, self.label, replace(self.params, **changes), self.key)

    def fit(self, df: DataFrame) -> TreeModel:
        return fit_together(df, [self], [None])[0]


def fit_together(
    df: DataFrame, estimators: Sequence[BoostedTrees], dates: Sequence[frozenset[int] | None],
    when: Column | None = None, samples: dict[str, Column] | None = None, used: Sequence[str | None] | None = None,
    key: Sequence[str] = (), cuts_from: Column | None = None,
) -> list[TreeModel]:
    """One model per estimator, of its dates (numbers of ``when``) and its sample column.

    All are fitted in the same passes. ``cuts_from`` says whose rows set the cuts, where some
    rows must not be looked at yet.
    """
    first = estimators[0]
    if first.params.objective == "squared_log":  # labels of -1 or less have no loss
        df = df.where(F.col(first.label) > -1)
    bins = max(e.params.max_bins for e in estimators)
    cuts = None
    if cuts_from is not None:
        seen = df.where(cuts_from & F.col(first.label).isNotNull())
        cuts = quantile_cuts(seen.select(*[F.col(c).cast("double").alias(c) for c in first.features]), first.features, bins)
    data = bin_panel(df, first.features, first.label, bins, when, key or first.key, cuts, samples)
    jobs = [Job(e.params, m, s) for e, m, s in zip(estimators, dates, used or [None] * len(estimators))]
    return fit_jobs(data, jobs)
