"""Elementwise losses, gradients and labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors that keep the formulas finite.
MAPE_FLOOR = 1e-7
LOG_FLOOR = -1 + 1e-6


def _log_argument(pred: Column) -> Column:
    return F.when(pred < -1, F.lit(LOG_FLOOR)).otherwise(pred)


LOSSES = {
    "half_squared": lambda y, p: F.pow(p - y, F.lit(2.0)) / 2,
    "ape": lambda y, p: 100 * F.abs(y - p) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR)),
    "squared_log": lambda y, p: F.pow(F.log1p(y) - F.log1p(_log_argument(p)), F.lit(2.0)),
    "log_abs": lambda y, p: F.log1p(F.abs(p - y)),
    "log_square": lambda y, p: F.log1p(F.pow(p - y, F.lit(2.0))),
}


def rmsle(y: Column, pred: Column) -> Column:
    """Aggregate: root of the mean squared log error."""
    return F.sqrt(F.avg(LOSSES["squared_log"](y, pred)))


def gradients(objective: str, y: Column, pred: Column) -> tuple[Column, Column]:
    """First and second derivative of a boosting objective by the prediction."""
    gap = pred - y
    square = F.pow(gap, F.lit(2.0))
    if objective == "mse":
        return gap, F.lit(1.0)
    if objective == "squared_log":
        p = _log_argument(pred)
        ratio = F.log1p(p) - F.log1p(y)
        return ratio / (p + 1), (1 - ratio) / F.pow(p + 1, F.lit(2.0))
    if objective == "log_square":
        return 2 * gap / (square + 1), -2 * (square - 1) / F.pow(square + 1, F.lit(2.0))
    if objective == "mape":
        return 100 * F.signum(gap) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR)), F.lit(0.0)
    if objective == "log_abs":
        wide = F.abs(gap) + 1
        return F.signum(gap) / wide, -1 / F.pow(wide, F.lit(2.0))
    raise ValueError(f"unknown objective {objective}")


def argmax_label(scores: Column, labels: Sequence) -> Column:
    """Label of the largest entry of an array of class scores; first one on ties."""
    at = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.get(F.array(*[F.lit(x) for x in labels]), at)


def params_label(params: Column) -> Column:
    """``name=value, name=value`` of a parameter map, by name."""
    pairs = F.transform(
        F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(pairs, ", ")


def group_label(parts: Sequence[tuple[str, Column | str]]) -> Column:
    """``"Diff Q1; PM Q5"`` from (feature name, class column); the name loses ``_Exp``."""
    texts = [
        F.concat(F.lit(f"{name[:-4]} "), (F.col(c) if isinstance(c, str) else c).cast("string"))
        for name, c in parts
    ]
    return F.concat_ws("; ", *texts)


def code_prefix(code: Column, digits: int = 2) -> Column:
    """Leading digits of a numeric code, as a number."""
    return F.substring(code.cast("bigint").cast("string"), 1, digits).cast("double")


def label_of(code: Column, names: dict) -> Column:
    """Name of a code by a small fixed mapping; unknown codes have none."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)
