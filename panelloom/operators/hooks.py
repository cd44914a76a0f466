"""User functions over rows, groups and pairs of groups, as Arrow batches.

Column expressions come first; these are for what they cannot say. A group function needs its
group in one task, so every hook bounds the rows it may be given: a larger group is an error
that names it, or, where a ``merge`` function is given, is worked on in parts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import side

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a group that one task may hold.
GROUP_ROWS = 1_000_000


def apply_elements(df: DataFrame, columns: Sequence[str], function: Callable, output: str, kind: str) -> DataFrame:
    """Add ``function(*columns)``: vectors in, a vector of ``kind`` out, batch by batch."""

    def run(*vectors: pd.Series) -> pd.Series:
        return pd.Series(function(*vectors))

    return df.withColumn(output, F.pandas_udf(run, kind)(*[F.col(c) for c in columns]))


def apply_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of each batch through a function of a frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def check_groups(df: DataFrame, by: Sequence[str], limit: int) -> None:
    """Fail with the largest group's key if it has more rows than one task may hold."""
    top = df.groupBy(*by).count().orderBy(F.col("count").desc(), *by).first()
    if top is not None and top["count"] > limit:
        key = ", ".join(f"{c}={top[c]}" for c in by)
        raise ValueError(f"group ({key}) has {top['count']} rows, at most {limit}; give a merge function")


def parts_of(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Add ``_part``: a group of more than ``limit`` rows is dealt over as many parts as it needs.

    Twice as many parts as would fill up, so that hashing leaves each below the limit.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_parts", F.when(F.col("_n") > limit, F.ceil(2 * F.col("_n") / limit)).otherwise(1))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in by]
    joined = df.alias("_l").join(side(sizes).alias("_r"), same).select("_l.*", "_r._parts")
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))
    return joined.withColumn("_part", row).drop("_parts")


def apply_groups(
    df: DataFrame, by: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, limit: int = GROUP_ROWS,
) -> DataFrame:
    """A frame per group from ``function`` of the group's rows.

    With ``merge`` the function sees parts of at most about ``limit`` rows, and merge makes one
    frame of the parts' frames of a group (both of ``schema``, which names the group's columns).
    """
    by = list(by)
    if merge is None:
        check_groups(df, by, limit)
        return df.groupBy(*by).applyInPandas(function, schema)

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows.drop(columns="_part"))

    return parts_of(df, by, limit).groupBy(*by, "_part").applyInPandas(part, schema).groupBy(*by).applyInPandas(merge, schema)


def transform_groups(
    df: DataFrame, by: Sequence[str], column: str, function: Callable[[pd.Series], pd.Series], output: str,
    limit: int = GROUP_ROWS, order: Sequence[str] = (),
) -> DataFrame:
    """Add ``function`` of the group's values of a column, one value (double) per row.

    ``order`` sorts the values that the function sees.
    """
    check_groups(df, by, limit)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != output]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), ignore_index=True) if order else rows
        return rows.assign(**{output: pd.Series(function(rows[column])).to_numpy(dtype=float)})

    keep = df.drop(output) if output in df.columns and output != column else df
    return keep.groupBy(*by).applyInPandas(run, ", ".join([*kinds, f"`{output}` double"]))


def apply_cogroups(
    left: DataFrame, right: DataFrame, by: Sequence[str], function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str, limit: int = GROUP_ROWS,
) -> DataFrame:
    """A frame per group from both sides' rows; a side without the group gives an empty frame."""
    check_groups(left, by, limit)
    check_groups(right, by, limit)
    right = right.toDF(*right.columns)  # both may come from one frame
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(function, schema)
