"""Purged k-fold cross-validation and grid search; results are one long table.

Columns of a result: ``model_id, epoch, fold, partition, metric, value``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from types import ModuleType

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import logistic, trees
from ..session import attach_side, hold, release, settle, side
from .linear import add_moments, linear_score, moments, solve_ridge
from .logistic import Logistic
from .metrics import evaluate_classifier, evaluate_model
from .profile import argmax_row
from .splits import fold_role, in_sample, purged_folds
from .trees import BoostedTrees

KEYS = ["model_id", "epoch", "fold", "partition"]


def _with_epochs(df: DataFrame, n_epoch: int) -> DataFrame:
    epochs = F.array(*[F.lit(e) for e in range(n_epoch)])
    return df.withColumn("epoch", F.explode(epochs))


def ridge_cv(
    df: DataFrame,
    date: str,
    key: Sequence[str],
    features: Sequence[str],
    label: str,
    alphas: Sequence[float],
    folds: Sequence[tuple[dt.date, dt.date]],
    purge_length: int,
    embargo_length: int = 0,
    train_from_future: bool = False,
    subsample: float = 1.0,
    n_epoch: int = 1,
    fit_intercept: bool = True,
    strategy: dict | None = None,
) -> DataFrame:
    """Cross-validate ridge models of every alpha, epoch and fold at once.

    The panel is aggregated once to monthly sums (per epoch, of that epoch's sample); a
    fold's training set is the sum of the months it keeps, and every alpha is solved
    from the same sums. A second pass scores all rows with all models, and folds and
    models are mere group keys of the evaluation. The panel's needed columns are held
    for these passes; the scores (models x folds x metrics) are settled.
    """
    p = len(features)
    needed = [date, *key, *features, label, *([strategy["label_fm"]] if strategy else [])]
    held = hold(df.select(*dict.fromkeys(needed)))
    rows = _with_epochs(held, n_epoch)
    sampled = in_sample(key, subsample, F.col("epoch")) if subsample < 1 else F.lit(True)
    monthly = moments(rows.where(sampled), features, label, ["epoch", date])
    rule = (folds, purge_length, embargo_length, train_from_future)
    train = purged_folds(monthly, date, *rule).where("role = 'train'")
    per_fold = add_moments(train, ["epoch", "fold"], p)
    models = F.array(
        *[F.struct(F.lit(i).alias("model_id"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(alphas)]
    )
    sets = per_fold.select("*", F.explode(models).alias("_m")).select("*", "_m.*").drop("_m")
    solved = solve_ridge(sets, p, F.col("alpha"), fit_intercept)
    coefs = [f"coef_{i}" for i in range(p)]
    fits = solved.groupBy("epoch", "fold").agg(
        # One entry per parameter set.
        F.collect_list(F.struct("model_id", "intercept", *coefs)).alias("_fits")
    )
    used = purged_folds(rows.where(F.col(label).isNotNull()), date, *rule)
    used = used.where((F.col("role") == "val") | sampled).withColumnRenamed("role", "partition")
    scored = attach_side(used, side(fits), ["epoch", "fold"], "inner")
    scored = scored.select("*", F.explode("_fits").alias("_fit")).select("*", "_fit.*")
    scored = scored.withColumn("pred", linear_score(features)).drop("_fits", "_fit")
    scores = settle(evaluate_model(scored, "reg", label, KEYS, strategy))
    release(held)
    return scores


def fold_frames(df: DataFrame, date: str, fold, rule: tuple) -> tuple[DataFrame, DataFrame]:
    """Train and validation frame of one fold."""
    begin, end = (F.lit(d).cast("date") for d in fold)
    role = fold_role(F.col(date), begin, end, *rule)
    tagged = df.withColumn("_role", role)
    return tuple(tagged.where(F.col("_role") == r).drop("_role") for r in ("train", "val"))


def estimator_cv(
    df: DataFrame,
    date: str,
    key: Sequence[str],
    label: str,
    make: Callable[[dict], Estimator],
    param_sets: Sequence[dict],
    folds: Sequence[tuple[dt.date, dt.date]],
    kind: str,
    purge_length: int,
    embargo_length: int = 0,
    train_from_future: bool = False,
    subsample: float = 1.0,
    n_epoch: int = 1,
    strategy: dict | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """The same for any estimator that writes ``pred``: one fit per set, epoch and fold.

    Boosted trees and logistic models are fitted together, see ``joint_cv``. Other fits are
    submitted from a few driver threads; each is a Spark job of its own. The scores of one fit
    are few rows and are settled, so no fit is ever repeated.
    """
    rule = (purge_length, embargo_length, train_from_future)
    made = [make(params) for params in param_sets]
    for joint, fits in ((BoostedTrees, trees), (Logistic, logistic)):
        if all(isinstance(m, joint) for m in made):
            return joint_cv(df, date, key, label, made, fits, folds, kind, rule, subsample, n_epoch, strategy)
    held = hold(df)

    def run(task):
        (i, params), epoch, (f, fold) = task
        train, val = fold_frames(held, date, fold, rule)
        if subsample < 1:
            train = train.where(in_sample(key, subsample, epoch))
        if not train.limit(1).count():
            return None
        model = make(params).fit(train)
        both = model.transform(train).withColumn("partition", F.lit("train")).unionByName(
            model.transform(val).withColumn("partition", F.lit("val"))
        )
        scores = evaluate_model(both, kind, label, ["partition"], strategy)
        tags = [F.lit(i).alias("model_id"), F.lit(epoch).alias("epoch"), F.lit(f).alias("fold")]
        return settle(scores.select(*tags, "partition", "metric", "value"))

    tasks = [
        (s, e, f)
        for s in enumerate(param_sets)
        for e in range(n_epoch)
        for f in enumerate(folds)
    ]
    with ThreadPoolExecutor(parallelism) as pool:
        parts = [r for r in pool.map(run, tasks) if r is not None]
    release(held)
    return reduce(DataFrame.unionByName, parts)


def joint_cv(
    df: DataFrame,
    date: str,
    key: Sequence[str],
    label: str,
    estimators: Sequence[BoostedTrees | Logistic],
    fits: ModuleType,
    folds: Sequence[tuple[dt.date, dt.date]],
    kind: str,
    rule: tuple,
    subsample: float,
    n_epoch: int,
    strategy: dict | None,
) -> DataFrame:
    """Every parameter set, epoch and fold in the same passes over one panel.

    A model's training rows are a set of dates, so folds need no frames of their own. All
    models score a row at once, and fold, epoch and model are mere keys of the evaluation.
    """
    needed = [date, *key, *estimators[0].features, label, *([strategy["label_fm"]] if strategy else [])]
    held = hold(df.select(*dict.fromkeys(needed)).where(F.col(label).isNotNull()))
    # A calendar: one row per date and fold.
    days = purged_folds(held.select(date).distinct(), date, folds, *rule).where("role = 'train'")
    train: dict[int, set[int]] = {}
    for r in days.select("fold", F.unix_date(date).alias("day")).collect():
        train.setdefault(r["fold"], set()).add(r["day"])
    used = sorted(train)  # folds with something to learn from
    samples = {f"_s{e}": in_sample(key, subsample, e) for e in range(n_epoch)} if subsample < 1 else {}
    jobs = [(m, e, f) for m in estimators for e in range(n_epoch) for f in used]
    models = fits.fit_together(
        held, [m for m, _, _ in jobs], [frozenset(train[f]) for _, _, f in jobs], F.unix_date(date), samples,
        [f"_s{e}" if samples else None for _, e, _ in jobs], key,
    )
    rows = held.withColumn("_p", fits.prediction_column(models, estimators[0].features))
    rows = purged_folds(_with_epochs(rows, n_epoch), date, folds, *rule).where(F.col("fold").isin(used))
    if samples:
        rows = rows.where((F.col("role") == "val") | in_sample(key, subsample, F.col("epoch")))
    place = F.array_position(F.array(*[F.lit(f) for f in used]), F.col("fold").cast("int")) - 1
    first = F.col("epoch") * len(used) + place
    each = F.transform(
        F.sequence(F.lit(0), F.lit(len(estimators) - 1)),
        lambda i: F.struct(
            i.alias("model_id"), F.get("_p", (i * n_epoch * len(used) + first).cast("int")).alias("pred")
        ),
    )
    scored = rows.withColumn("_m", F.explode(each)).select("*", "_m.*").drop("_m", "_p")
    scored = scored.withColumnRenamed("role", "partition").where(F.col("pred").isNotNull())
    scores = settle(evaluate_model(scored, kind, label, KEYS, strategy))
    release(held)
    return scores


def summarize_cv(long: DataFrame) -> DataFrame:
    """Mean, population std and the fold values of every model, partition and metric."""
    values = F.array_sort(F.collect_list(F.struct("epoch", "fold", "value")))
    return long.groupBy("model_id", "partition", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        # Epochs x folds entries.
        F.transform(values, lambda v: v["value"]).alias("values"),
    )


def wide_cv(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model: ``<metric>_<partition>_mean/_std/_values``."""
    cells = []
    for m in metrics:
        for part in ("train", "val"):
            here = (F.col("metric") == m) & (F.col("partition") == part)
            for c in ("mean", "std", "values"):
                cells.append(F.first(F.when(here, F.col(c)), True).alias(f"{m}_{part}_{c}"))
    return summary.groupBy("model_id").agg(*cells)


def standardize_metrics(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """z-scores of the fold values over all models and folds of a partition and metric."""
    whole = W.partitionBy("partition", "metric")
    chosen = long.where(F.col("metric").isin(list(metrics)))
    z = (F.col("value") - F.avg("value").over(whole)) / F.nullif(
        F.stddev_samp("value").over(whole), F.lit(0.0)
    )
    return chosen.withColumn("zscore", z)


def combined_metric(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Equal-weighted mean of the z-scores, as one more metric of the long table."""
    z = standardize_metrics(long, metrics)
    return z.groupBy(*KEYS).agg(F.avg("zscore").alias("value")).select(
        *KEYS, F.lit("combined_zscore").alias("metric"), "value"
    )


def combined_summary(combined: DataFrame) -> DataFrame:
    return combined.groupBy("model_id", "partition").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def overfit_penalised(spreads: DataFrame) -> DataFrame:
    """From (model_id, split, diff): ``val - abs(train - val)`` of every model."""

    def of(name):
        return F.max(F.when(F.col("split") == name, F.col("diff")))

    out = spreads.groupBy("model_id").agg(of("train").alias("train_diff"), of("test").alias("val_diff"))
    metric = F.col("val_diff") - F.abs(F.col("train_diff") - F.col("val_diff"))
    return out.withColumn("metric", metric)


def best_model(scores: DataFrame, metric: str = "metric") -> DataFrame:
    """Row of the best metric, lowest id on ties."""
    return argmax_row(scores, "model_id", metric)


class MacroF1(Evaluator):
    """Macro-averaged f1 of ``pred`` for Spark's own cross-validator."""

    def __init__(self, label: str, pred: str = "prediction"):
        super().__init__()
        self.label, self.pred = label, pred

    def _evaluate(self, dataset: DataFrame) -> float:
        return evaluate_classifier(dataset, self.label, self.pred).first()["macro_f1"]

    def isLargerBetter(self) -> bool:
        return True

    def copy(self, extra=None):
        return MacroF1(self.label, self.pred)


def grid_search_cv(df: DataFrame, estimator: Estimator, grid, label: str, k: int, parallelism=2, seed=0):
    """Plain k-fold search by macro f1, refitted on all rows."""
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=MacroF1(label), numFolds=k,
        parallelism=parallelism, seed=seed,
    )
    return search.fit(df)
