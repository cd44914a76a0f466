"""A whole study: search, selection, prediction, ranking, backtest and tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crossval, interpret, linear, metrics, returns, selection
from ..operators.bins import rank_predictions
from ..operators.learners import predict
from ..operators.splits import expand_grid, month_span, train_test_split_by_date, val_dates
from ..operators.trees import TreeParams
from ..session import hold, release, settle
from ..sources.commits import commit_run, fingerprint, read_run, withdraw
from ..sources.writers import write_results


@dataclass(frozen=True)
class StudyConfig:
    """What to study; ``make`` builds an estimator from parameters, None means ridge."""

    date: str
    key: Sequence[str]
    features: Sequence[str]
    label: str
    label_fm: str
    test_begin: str
    test_end: str
    param_grid: dict[str, Sequence]
    kind: str = "reg"  # or "cla"
    make: Callable[[dict], Estimator] | None = None
    k: int = 3
    purge_length: int = 3
    embargo_length: int = 0
    subsample: float = 1.0
    n_epoch: int = 1
    train_from_future: bool = True
    force_val_length: int | None = None
    cv_metrics: Sequence[str] = ("r2",)
    p_threshold: float = 0.05
    metric_selection: str | None = None
    n_bins: int = 5
    top: int = 4
    bottom: int = 0
    rank: bool = True  # classification: rank predictions per month before the backtest
    edge: str | None = None  # regression: blend the prediction with this column
    expand_window: bool = False
    step: float = 0.1
    limits: Sequence[tuple[float, float]] | None = None
    extra: Sequence[str] = field(default_factory=tuple)


def search(config: StudyConfig, train: DataFrame) -> DataFrame:
    """Long cross-validation table of every parameter set, with the combined metric."""
    span = month_span(train, config.date)
    folds = val_dates(*span, config.k, config.force_val_length)
    common = {
        "folds": folds,
        "purge_length": config.purge_length,
        "embargo_length": config.embargo_length,
        "train_from_future": config.train_from_future,
        "subsample": config.subsample,
        "n_epoch": config.n_epoch,
    }
    sets = expand_grid(config.param_grid)
    strategy = None
    if config.kind == "reg":
        strategy = {
            "date": config.date, "label_fm": config.label_fm, "n_bins": config.n_bins,
            "top": config.top, "bottom": config.bottom, "ties": list(config.key),
        }
    if config.make is None:
        long = crossval.ridge_cv(
            train, config.date, config.key, config.features, config.label,
            [p["alpha"] for p in sets], strategy=strategy, **common,
        )
    else:
        long = crossval.estimator_cv(
            train, config.date, config.key, config.label, config.make, sets, kind=config.kind,
            strategy=strategy, **common,
        )
    # Both searches return settled scores.
    if len(sets) > 1:
        long = long.unionByName(crossval.combined_metric(long, config.cv_metrics))
    return long


def _ridge_predictions(config: StudyConfig, panel, train, test, alpha, columns):
    if config.expand_window:
        scored = linear.walk_forward(
            panel, config.date, config.features, config.label, config.test_begin, config.test_end, alpha
        )
        # The train side is scored by the last month's model.
        fits = linear.expanding_fits(
            panel.where(F.col(config.date) <= F.lit(config.test_end).cast("date")),
            config.date, config.features, config.label, config.test_begin, alpha,
        )
        latest = settle(returns.latest_row(fits, config.date))
        last, day = latest.drop(config.date), latest.first()[config.date]
        final = panel.where(F.col(config.date) < F.lit(day))
        return linear.predict_linear(final, last, config.features).select(*columns, "pred"), \
            scored.select(*columns, "pred")
    coefs = settle(linear.fit_ridge(train, config.features, config.label, alpha))
    return tuple(
        linear.predict_linear(d, coefs, config.features).select(*columns, "pred") for d in (train, test)
    )


def _described(config: StudyConfig) -> dict:
    """The configuration as plain values; an estimator is described by what it builds."""
    out = {f.name: getattr(config, f.name) for f in fields(config) if f.name != "make"}
    if config.make is not None:
        out["make"] = [
            (type(m).__name__, {k: v for k, v in vars(m).items() if isinstance(v, (str, int, float, list, tuple, dict, TreeParams))})
            for m in (config.make(p) for p in expand_grid(config.param_grid))
        ]
    return out


def run_study(
    spark: SparkSession, config: StudyConfig, panel: DataFrame, output: str | None = None,
    model: str = "model", read_last: bool = False,
) -> dict[str, DataFrame]:
    """Run the study; every result is a DataFrame and, with ``output``, a stored table.

    Stored tables are committed together at the end. With ``read_last`` a committed search of the
    same configuration and panel files is read instead of run again.
    """
    mark = fingerprint(_described(config), panel)
    columns = list(
        dict.fromkeys(
            [config.date, *config.key, *config.features, config.label, config.label_fm,
             *([config.edge] if config.edge else []), *config.extra]
        )
    )
    # Search, fit and prediction read the same columns; nothing else of the panel is kept.
    panel = hold(panel.select(*columns))
    train, test = train_test_split_by_date(
        panel, config.date, config.test_begin, config.test_end,
        train_from_future=config.train_from_future,
    )
    cached = read_run(spark, output, model, "cv_long", mark) if output and read_last else None
    # What is written below replaces the stored search, so it is settled first.
    long = search(config, train) if cached is None else settle(cached)
    validation = long.where("partition = 'val'")
    chosen = settle(
        selection.select_best_model(
            validation, [], config.cv_metrics, config.p_threshold, config.metric_selection
        )
    )
    # The one number that the driver needs to go on: which parameter set to fit.
    selected = chosen.first()["id_selected"]
    params = expand_grid(config.param_grid)[selected]
    if config.make is None:
        sides = _ridge_predictions(config, panel, train, test, params["alpha"], columns)
    else:
        sides = predict(config.make(params), train, test, columns, config.date, config.expand_window)
    pred = sides[0].withColumn("split", F.lit("train")).unionByName(
        sides[1].withColumn("split", F.lit("test"))
    )
    pred = settle(pred)
    used = "pred"
    if config.edge:
        weights = linear.fit_blend(pred.where("split = 'train'"), "pred", config.edge, config.label)
        pred = linear.blend(pred, weights, "pred", config.edge)
        used = "pred_return"
    by = ["split"]
    if config.kind == "reg" or config.rank:
        pred = rank_predictions(pred, config.n_bins, [*by, config.date], config.key, col_pred=used)
        cls = f"{used}_rank"
    else:
        pred = pred.withColumn("pred_class", F.col("pred").cast("int"))
        cls = "pred_class"
    strategy = None
    if config.kind == "reg":
        strategy = {
            "date": config.date, "label_fm": config.label_fm, "n_bins": config.n_bins,
            "top": config.top, "bottom": config.bottom, "ties": list(config.key),
        }
    scores = metrics.evaluate_model(
        pred.where(F.col(config.label).isNotNull()), config.kind, config.label, by, strategy
    )
    back = returns.perform_backtest(
        pred, config.date, cls, range(config.n_bins), config.label_fm, config.top, config.bottom, by
    )
    by_metric = ["metric"]
    results = {
        "cv_results": crossval.summarize_cv(long),
        "cv_long": long,
        "anova": selection.anova(validation, by_metric),
        "selected_model": chosen,
        "pred": pred,
        "model_evaluation": scores,
        "cum_return": back["cum_return"],
        "backtest_diff": back["diff"],
    }
    if len(expand_grid(config.param_grid)) > 1:
        results["post_hoc"] = selection.post_hoc(validation, by_metric, config.p_threshold)
    if config.kind == "reg":
        gap = interpret.residuals(pred, config.label)
        results["residuals"] = interpret.histogram(gap, "residual", 50, by, common_over=by)
    if config.make is None and len(config.features) <= 2 and not config.expand_window:
        coefs = linear.fit_ridge(train, config.features, config.label, params["alpha"])
        limits = config.limits or interpret.data_limits(train, config.features)
        results["surface"] = interpret.surface(
            spark, settle(coefs), config.features, config.step, limits
        )
    if output:
        withdraw(spark, output, model)
        write_results(results, output, model)
        commit_run(spark, output, model, results, mark)
    # What is still lazy reads settled tables only.
    release(panel)
    return results


def save_summary(cv_results: DataFrame, selected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-validation rows of the selected models, without the fold values."""
    chosen = selected.select(*keys, F.col("id_selected").alias("model_id"))
    return cv_results.join(chosen, [*keys, "model_id"], "left_semi").drop("values")


def join_predictions(
    panel: DataFrame, predictions: DataFrame, key: Sequence[str], features: Sequence[str],
    models: Sequence[str],
) -> DataFrame:
    """Add one ``Pred_<features>_<model>`` column per model, joined by the row key."""
    label = "_".join(features)
    wide = predictions.where(F.col("model").isin(list(models))).groupBy(*key).agg(
        *[
            F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"Pred_{label}_{m}")
            for m in models
        ]
    )
    return panel.join(wide, list(key), "left")
