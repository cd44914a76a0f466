"""Scores of predictions; larger is better for every regression score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LOSSES, rmsle
from .bins import rank_predictions
from .returns import monthly_spread

REGRESSION = ("r2", "mse", "mae", "mape", "mlse")
STRATEGY = ("Top-Bottom", "Top-Bottom-std")


def evaluate_regressor(df: DataFrame, label: str, pred: str = "pred", by: Sequence[str] = ()):
    """r2 and the negated mse, mae, mape and mlse of every group in one aggregation."""
    y, p = F.col(label), F.col(pred)
    known = df.where(y.isNotNull() & p.isNotNull())
    square = F.pow(y - p, F.lit(2.0))
    total = F.var_pop(y) * F.count(y)
    return known.groupBy(*by).agg(
        (1 - F.sum(square) / F.nullif(total, F.lit(0.0))).alias("r2"),
        (-F.avg(square)).alias("mse"),
        (-F.avg(F.abs(y - p))).alias("mae"),
        (-F.avg(LOSSES["ape"](y, p))).alias("mape"),
        (-F.avg(LOSSES["log_square"](y, p))).alias("mlse"),
    )


def class_report(df: DataFrame, label: str, pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and f1 per class from the confusion counts; 0/0 counts as 0."""
    confusion = df.groupBy(*by, F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("_y").cast("string").alias("cls"), F.col("_n").alias("support"),
            zero.alias("predicted"), hit.cast("bigint").alias("hits"),
        ),
        F.struct(
            F.col("_p").cast("string").alias("cls"), zero.alias("support"),
            F.col("_n").alias("predicted"), zero.alias("hits"),
        ),
    )
    per = (
        confusion.select(*by, F.explode(sides).alias("_s"))
        .select(*by, "_s.*")
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return per.select(
        *by,
        "cls",
        "support",
        "hits",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + predicted).alias("f1"),
    )


def evaluate_classifier(
    df: DataFrame, label: str, pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy with macro and support-weighted averages of the class report."""
    report = class_report(df, label, pred, by)
    whole = F.sum("support")
    return report.groupBy(*by).agg(
        (F.sum("hits") / whole).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[
            (F.sum(F.col(c) * F.col("support")) / whole).alias(f"weighted_{c}")
            for c in ("precision", "recall", "f1")
        ],
    )


def evaluate_top_bottom(
    df: DataFrame,
    date: str,
    label_fm: str,
    n_bins: int,
    top: int,
    bottom: int,
    ties: Sequence[str],
    by: Sequence[str] = (),
    pred: str = "pred",
    class_names=None,
) -> DataFrame:
    """Mean monthly spread of top over bottom predictions, plain and per unit of risk."""
    by = list(by)
    ranked = rank_predictions(df, n_bins, [*by, date], ties, class_names, pred)
    spread = monthly_spread(ranked, date, f"{pred}_rank", top, bottom, label_fm, by)
    mean = F.avg("spread")
    return spread.groupBy(*by).agg(
        mean.alias("Top-Bottom"),
        (mean / F.nullif(F.stddev_samp("spread"), F.lit(0.0))).alias("Top-Bottom-std"),
    )


def to_long(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, metric, value) rows."""
    return wide.unpivot(list(by), list(metrics), "metric", "value")


def evaluate_model(
    df: DataFrame, kind: str, label: str, by: Sequence[str] = (), strategy: dict | None = None
) -> DataFrame:
    """Long (by, metric, value) scores of a regression (``reg``) or classification (``cla``)."""
    by = list(by)
    if kind == "cla":
        macro = evaluate_classifier(df, label, by=by).withColumnsRenamed(
            {"macro_precision": "precision", "macro_recall": "recall", "macro_f1": "f1-score"}
        )
        out = to_long(macro, by, ["accuracy", "precision", "recall", "f1-score"])
        report = class_report(df, label, by=by).where("support > 0").withColumnRenamed("f1", "f1-score")
        per = report.unpivot([*by, "cls"], ["f1-score", "precision", "recall"], "m", "value")
        per = per.select(*by, F.concat_ws("_", "cls", "m").alias("metric"), "value")
        return out.unionByName(per)
    out = to_long(evaluate_regressor(df, label, by=by), by, REGRESSION)
    if strategy:
        scores = evaluate_top_bottom(df, by=by, **strategy)
        out = out.unionByName(to_long(scores, by, STRATEGY))
    return out


def mean_losses(df: DataFrame, label: str, pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Mean of every elementwise loss, and the root mean squared log error."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        *[F.avg(loss(y, p)).alias(name) for name, loss in LOSSES.items()],
        rmsle(y, p).alias("rmsle"),
    )
