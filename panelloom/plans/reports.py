"""Frames prepared for comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_frames(frames: dict[str, DataFrame], features: Sequence[str]) -> DataFrame:
    """Long (Dataset, feature, Value) rows of several data sets."""
    parts = [
        df.select(F.lit(name).alias("Dataset"), *features).unpivot(
            ["Dataset"], list(features), "feature", "Value"
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)
