"""One configurable preparation job for raw panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import clean
from ..operators.bins import discretize_by_month


@dataclass(frozen=True)
class PrepareConfig:
    date: str
    key: Sequence[str]
    features: Sequence[str]
    targets: Sequence[str] = ()
    finite: Sequence[str] = ()
    negated: Sequence[str] = ()
    winsorize: tuple[float, float] | None = None
    standardize: str | None = None  # None, "mean" or "median"
    by_month: bool = True
    impute: str | None = "month"
    # (variable, number of classes, suffix) of each class column
    bins: Sequence[tuple[str, int, str]] = field(default_factory=tuple)


def prepare_panel(df: DataFrame, config: PrepareConfig) -> DataFrame:
    """Clean, winsorize, scale, impute and bin, in this order; each step is optional."""
    by = [config.date] if config.by_month else None
    features = list(config.features)
    out = df
    if config.finite:
        out = clean.drop_infinite(out, config.finite)
    if config.targets:
        out = clean.remove_missing_targets(out, config.targets)
    if config.negated:
        out = clean.negate(out, config.negated)
        features += [f"-{f}" for f in config.negated]
    if config.winsorize:
        out = clean.winsorize(out, features, *config.winsorize, by=by)
    if config.standardize:
        out = clean.standardize(out, features, by, config.standardize)
    if config.impute:
        out = clean.impute_data(out, config.impute, features, config.key[0], config.date, config.key[1:])
    for variable, n, suffix in config.bins:
        out = discretize_by_month(out, [variable], n, config.date, config.key, suffix=suffix)
    return out
