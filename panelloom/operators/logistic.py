"""Logistic regression by Newton steps over map-side sums.

A step needs the gradient and the Hessian of the loss, whose size is set by factors and
classes. Tasks add them up, Spark adds the tasks, the driver solves one small system per
model. All classes of a model and all models that are fitted together (folds, penalties) share
every pass, so a search takes as many passes as its slowest model takes steps.

The penalty is stated as ``c``: the summed loss plus ``|w|^2 / (2 c)``, the intercept free.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .passes import add_up_array, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LogisticParams:
    """``scheme``: multinomial (softmax) or ovr (each class against the rest); ``c`` None: no penalty."""

    n_classes: int
    c: float | None = None
    scheme: str = "multinomial"
    max_iter: int = 25
    tol: float = 1e-10


@dataclass
class LogisticModel:
    """``weights`` has a row per class: the intercept, then one weight per factor."""

    features: list[str]
    params: LogisticParams
    weights: np.ndarray
    steps: int = 0

    def margins(self) -> list[Column]:
        out = []
        for row in self.weights:
            margin = F.lit(float(row[0]))
            for w, c in zip(row[1:], self.features):
                margin = margin + F.lit(float(w)) * F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            out.append(margin)
        return out

    def pred_column(self) -> Column:
        """Class of the largest margin, first one on ties; null where a factor is missing."""
        margins = F.array(*self.margins())
        best = (F.array_position(margins, F.array_max(margins)) - 1).cast("double")
        return F.when(self.margins()[0].isNotNull(), best)

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        """Every row, with ``probability`` (an array by class) and the likeliest class."""
        margins = self.margins()
        if self.params.scheme == "ovr":
            parts = F.array(*[1 / (1 + F.exp(-m)) for m in margins])
        else:
            top = F.greatest(*margins) if len(margins) > 1 else margins[0]
            parts = F.array(*[F.exp(m - top) for m in margins])
        total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
        share = F.when(margins[0].isNotNull(), F.transform(parts, lambda v: v / total))
        return df.withColumns({"probability": share, output: self.pred_column()})

    def coefficients(self, spark) -> DataFrame:
        names = ["intercept", *self.features]
        rows = [(k, n, float(v)) for k, row in enumerate(self.weights) for n, v in zip(names, row)]
        return spark.createDataFrame(rows, "class int, term string, value double")


@dataclass
class Job:
    """One model of a joint fit: its rows are those of ``dates`` (None: all) and ``sample``."""

    params: LogisticParams
    dates: frozenset[int] | None = None
    sample: str | None = None


def class_shares(margins: np.ndarray, scheme: str) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and log of one minus them under ovr (of them under multinomial)."""
    if scheme == "ovr":
        return 1 / (1 + np.exp(-margins)), -np.logaddexp(0, margins)
    top = margins.max(axis=1, keepdims=True)
    log = margins - top - np.log(np.exp(margins - top).sum(axis=1, keepdims=True))
    return np.exp(log), log


def derivatives(x: np.ndarray, y: np.ndarray, weights: np.ndarray, scheme: str) -> np.ndarray:
    """[loss, rows, gradient.., Hessian..] of the unpenalised loss, flat."""
    k, d = weights.shape
    margins = x @ weights.T
    p, log = class_shares(margins, scheme)
    hit = (y[:, None] == np.arange(k)).astype(float)
    hessian = np.zeros((k, d, k, d))
    if scheme == "ovr":
        loss = -(log + hit * margins).sum()
        for i in range(k):
            hessian[i, :, i, :] = (x * (p[:, i] * (1 - p[:, i]))[:, None]).T @ x
    else:
        loss = -(hit * log).sum()
        for i in range(k):
            for j in range(i, k):
                w = p[:, i] * ((i == j) - p[:, j])
                hessian[i, :, j, :] = (x * w[:, None]).T @ x
                hessian[j, :, i, :] = hessian[i, :, j, :]
    gradient = (p - hit).T @ x
    return np.concatenate([[loss, len(y)], gradient.reshape(-1), hessian.reshape(-1)])


def newton_step(sums: np.ndarray, weights: np.ndarray, c: float | None) -> tuple[float, np.ndarray, float]:
    """Penalised loss, the step, and the largest entry of the gradient per row."""
    k, d = weights.shape
    n = k * d
    gradient = sums[2 : 2 + n].reshape(k, d).copy()
    hessian = sums[2 + n :].reshape(n, n).copy()
    loss = sums[0]
    if c is not None:
        free = np.arange(d) > 0
        loss += (weights[:, free] ** 2).sum() / (2 * c)
        gradient += np.where(free, weights / c, 0.0)
        hessian += np.diag(np.tile(np.where(free, 1 / c, 0.0), k))
    # Softmax has directions without curvature; the shortest step leaves them alone.
    scale = 1 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))
    scaled = hessian * scale[:, None] * scale[None, :]
    step = -scale * np.linalg.lstsq(scaled, scale * gradient.reshape(-1), rcond=1e-12)[0]
    return loss, step.reshape(k, d), float(np.abs(gradient).max()) / max(sums[1], 1)


def fit_jobs(table: DataFrame, features: Sequence[str], jobs: Sequence[Job]) -> list[LogisticModel]:
    """Fit all jobs over a written table of the factors, ``_y``, date number ``_t`` and sample flags.

    Rows with a missing factor or label are left out. A step that raises the loss is halved.
    """
    jobs, features, d = list(jobs), list(features), len(features) + 1
    weights = [np.zeros((j.params.n_classes, d)) for j in jobs]
    before: list[tuple[float, np.ndarray] | None] = [None] * len(jobs)
    steps = [0] * len(jobs)
    open_ = list(range(len(jobs)))
    while open_:
        size = max(2 + (jobs[a].params.n_classes * d) * (jobs[a].params.n_classes * d + 1) for a in open_)
        now = [weights[a] for a in open_]
        chosen = [jobs[a] for a in open_]

        def fold(total: np.ndarray, batch: pa.RecordBatch) -> None:
            values = matrix(batch, [*features, "_y", "_t"])
            whole = ~np.isnan(values[:, : d]).any(axis=1)
            x = np.column_stack([np.ones(len(values)), values[:, : d - 1]])
            y, t = values[:, d - 1], values[:, d]
            for i, job in enumerate(chosen):
                use = whole.copy()
                if job.dates is not None:
                    use &= np.isin(t, np.fromiter(job.dates, float, len(job.dates)))
                if job.sample is not None:
                    use &= batch.column(batch.schema.get_field_index(job.sample)).to_numpy(zero_copy_only=False)
                if use.any():
                    found = derivatives(x[use], y[use], now[i], job.params.scheme)
                    total[i, : len(found)] += found

        sums = add_up_array(table, (len(open_), size), fold)
        still = []
        for i, a in enumerate(open_):
            k = jobs[a].params.n_classes
            loss, step, slope = newton_step(sums[i, : 2 + k * d * (k * d + 1)], weights[a], jobs[a].params.c)
            if before[a] is not None and loss > before[a][0] * (1 + 1e-12) + 1e-12:
                weights[a] = (weights[a] + before[a][1]) / 2
            elif slope <= jobs[a].params.tol:
                continue
            else:
                before[a] = (loss, weights[a])
                weights[a] = weights[a] + step
            steps[a] += 1
            if steps[a] < jobs[a].params.max_iter:
                still.append(a)
        open_ = still
    return [LogisticModel(features, j.params, centred(w, j.params.scheme), s) for j, w, s in zip(jobs, weights, steps)]


def centred(weights: np.ndarray, scheme: str) -> np.ndarray:
    """Softmax knows weights up to a common shift of all classes; theirs is to add up to zero."""
    return weights - weights.mean(axis=0) if scheme == "multinomial" else weights


def prediction_column(models: Sequence[LogisticModel], features: Sequence[str]) -> Column:
    """The array of the predictions of several models, for every row."""
    return F.array(*[m.pred_column() for m in models])


class Logistic:
    """Estimator: ``fit(df)`` gives a LogisticModel. Labels are 0, 1, ..; by default their
    number is that of the classes."""

    def __init__(
        self, features: Sequence[str], label: str, n_classes: int | None = None, c: float | None = None,
        scheme: str = "multinomial", max_iter: int = 25, tol: float = 1e-10,
    ):
        if scheme not in ("multinomial", "ovr"):
            raise ValueError(f"unknown scheme {scheme}")
        self.features, self.label, self.n_classes = list(features), label, n_classes
        self.rest = {"c": c, "scheme": scheme, "max_iter": max_iter, "tol": tol}

    def set_params(self, **changes) -> "Logistic":
        """The same estimator with other parameters."""
        return Logistic(self.features, self.label, self.n_classes, **{**self.rest, **changes})

    def params(self, df: DataFrame) -> LogisticParams:
        n = self.n_classes
        if n is None:
            top = df.agg(F.max(self.label)).first()[0]
            n = int(top) + 1 if top is not None else 1
        return LogisticParams(n, **self.rest)

    def fit(self, df: DataFrame) -> LogisticModel:
        return fit_together(df, [self], [None])[0]


def fit_together(
    df: DataFrame, estimators: Sequence[Logistic], dates: Sequence[frozenset[int] | None],
    when: Column | None = None, samples: dict[str, Column] | None = None, used: Sequence[str | None] | None = None,
    key: Sequence[str] = (),
) -> list[LogisticModel]:
    """One model per estimator, of its dates (numbers of ``when``) and its sample column."""
    first = estimators[0]
    params = first.params(df)
    samples = samples or {}
    rows = df.select(
        *[F.col(c).cast("double").alias(c) for c in first.features], F.col(first.label).cast("double").alias("_y"),
        (F.lit(0) if when is None else when).cast("int").alias("_t"), *[c.alias(n) for n, c in samples.items()],
    ).where("_y IS NOT NULL")
    table, path = write_table(rows, "logistic")
    jobs = [
        Job(LogisticParams(params.n_classes, **e.rest), m, s)
        for e, m, s in zip(estimators, dates, used or [None] * len(estimators))
    ]
    models = fit_jobs(table, first.features, jobs)
    drop_table(df.sparkSession, path)
    return models
