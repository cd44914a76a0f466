"""Date and entity splits, validation folds, purging and parameter grids."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach
from .order_stats import Target, select_ranks

FOLD_SCHEMA = "fold int, val_begin date, val_end date"


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def date_range(df: DataFrame, date: str, begin, end) -> DataFrame:
    """Rows with ``begin <= date <= end``; the plain column reaches the scan."""
    return df.where(F.col(date).between(_day(begin), _day(end)))


def train_test_split_by_date(
    df: DataFrame,
    date: str,
    test_begin,
    test_end,
    train_begin=None,
    train_end=None,
    train_from_future: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames; a given train range may overlap the test range."""
    d = F.col(date)
    test = date_range(df, date, test_begin, test_end)
    if train_begin is not None and train_end is not None:
        return date_range(df, date, train_begin, train_end), test
    train = d < _day(test_begin)
    if train_from_future:
        train = train | (d > _day(test_end))
    return df.where(train), test


def with_split(
    df: DataFrame, date: str, test_begin, test_end, train_begin=None, train_end=None,
    train_from_future: bool = False,
) -> DataFrame:
    """Both sides of the split in one frame, tagged ``split``; unused rows are dropped.

    Each row carries the list of its roles, so overlapping ranges work as well and the
    panel is scanned once.
    """
    d = F.col(date)
    if train_begin is not None and train_end is not None:
        train = d.between(_day(train_begin), _day(train_end))
    else:
        train = d < _day(test_begin)
        if train_from_future:
            train = train | (d > _day(test_end))
    test = d.between(_day(test_begin), _day(test_end))
    roles = F.array_compact(F.array(F.when(train, "train"), F.when(test, "test")))
    return df.where(train | test).select("*", F.explode(roles).alias("split"))


def train_test_split(
    df: DataFrame, date: str, test_begin, test_end, train_length: int | None = None, train_end=None
) -> tuple[DataFrame, DataFrame]:
    """Train on the ``train_length`` months that end at ``train_end``."""
    test = date_range(df, date, test_begin, test_end)
    if train_length is None:
        d = F.col(date)
        return df.where((d < _day(test_begin)) | (d > _day(test_end))), test
    end = _day(train_end)
    return date_range(df, date, F.add_months(end, -train_length), end), test


def hash_number(key: Column | str, seed: int = 0) -> Column:
    """A repeatable number in [0, 2^48) from a key; the same in any engine with md5."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(k.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def subsample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """Repeatable sample without replacement: the key's hash decides, row by row."""
    return df.where(in_sample(keys, fraction, seed))


def in_sample(keys: Sequence[str], fraction: float, seed: int | Column = 0) -> Column:
    salt = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pmod(F.xxhash64(*keys, salt), F.lit(1_000_000)) < F.lit(fraction * 1e6)


def split_by_entity(
    df: DataFrame, entity: str, stratum: str, train_size: float, seed: int = 0
) -> DataFrame:
    """Tag rows ``train`` or ``val`` so that an entity is on one side only, per stratum.

    The first ``ceil(n * train_size)`` entities of a stratum, in the order of their
    hash, train. Only that limit is looked up (``select_ranks``); entities of a large
    stratum are never put into one task.
    """
    entities = df.select(stratum, entity).distinct()
    hashed = entities.withColumn("_h", hash_number(entity, seed))
    cut = Target(train_size, lambda n: F.greatest(F.ceil(n * F.lit(train_size)), F.lit(1)))
    limits = select_ranks(hashed, [stratum], "_h", [cut], [entity])
    limits = limits.select(stratum, F.col("cuts")[0].alias("_limit"))
    here = F.struct(hash_number(entity, seed).cast("double").alias("x"), F.col(entity))
    side = F.when(here <= F.col("_limit"), "train").otherwise("val")
    return attach(df, limits, [stratum], "inner").withColumn("split", side).drop("_limit")


def month_span(df: DataFrame, date: str) -> tuple[dt.date, dt.date]:
    """First and last month of a panel (one row to the driver)."""
    row = df.agg(F.trunc(F.min(date), "month"), F.trunc(F.max(date), "month")).first()
    return row[0], row[1]


def _shift(day: dt.date, months: int) -> dt.date:
    total = day.year * 12 + day.month - 1 + months
    return dt.date(total // 12, total % 12 + 1, 1)


def val_dates(begin: dt.date, end: dt.date, k: int, force_val_length: int | None = None):
    """(val_begin, val_end) of every fold; the last one runs to the end of the data."""
    months = (end.year - begin.year) * 12 + end.month - begin.month
    length = force_val_length or int(months / k + 1)
    out = [(_shift(begin, i * length), _shift(begin, (i + 1) * length - 1)) for i in range(k)]
    out[-1] = (out[-1][0], end)
    return out


def fold_table(
    spark: SparkSession, df: DataFrame, date: str, k: int, force_val_length: int | None = None
) -> DataFrame:
    """The k validation periods as rows (k is a parameter, so the table is tiny)."""
    dates = val_dates(*month_span(df, date), k, force_val_length)
    return spark.createDataFrame([(i, b, e) for i, (b, e) in enumerate(dates)], FOLD_SCHEMA)


def fold_role(
    date: Column,
    val_begin: Column,
    val_end: Column,
    purge_length: int,
    embargo_length: int = 0,
    train_from_future: bool = False,
) -> Column:
    """``val``, ``train`` or NULL (purged, embargoed or later than allowed)."""
    in_val = date.between(val_begin, val_end)
    before = date.between(F.add_months(val_begin, -purge_length), F.add_months(val_begin, -1))
    after = date.between(
        F.add_months(val_end, 1), F.add_months(val_end, purge_length + embargo_length)
    )
    train = ~(before | after)
    train = train & ((date < val_begin) | ((date > val_end) & F.lit(bool(train_from_future))))
    return F.when(in_val, "val").when(train, "train")


def purged_folds(
    df: DataFrame,
    date: str,
    folds: Sequence[tuple[dt.date, dt.date]],
    purge_length: int,
    embargo_length: int = 0,
    train_from_future: bool = False,
) -> DataFrame:
    """Every row once per fold it takes part in, with ``fold`` and ``role``.

    The fold limits are literals, so this is a map-side expansion without any shuffle.
    """
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                fold_role(
                    F.col(date), _day(b), _day(e), purge_length, embargo_length, train_from_future
                ).alias("role"),
            )
            for i, (b, e) in enumerate(folds)
        ]
    )
    used = F.filter(options, lambda o: o["role"].isNotNull())
    return df.select("*", F.explode(used).alias("_f")).select("*", "_f.fold", "_f.role").drop("_f")


def expand_grid(param_grid: dict[str, Sequence]) -> list[dict]:
    """Parameter sets in product order, which is the order of preference."""
    return [dict(zip(param_grid, values)) for values in itertools.product(*param_grid.values())]


def grid_table(spark: SparkSession, param_grid: dict[str, Sequence]) -> DataFrame:
    """(model_id, params) rows of a parameter grid."""
    rows = [
        (i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(expand_grid(param_grid))
    ]
    schema = T.StructType(
        [
            T.StructField("model_id", T.IntegerType()),
            T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    return spark.createDataFrame(rows, schema)


def in_periods(df: DataFrame, date: str, periods: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A row once for every named (name, begin, end) period that contains its date."""
    d = F.col(date)
    names = F.array_compact(
        F.array(*[F.when(d.between(_day(b), _day(e)), F.lit(n)) for n, b, e in periods])
    )
    return df.select("*", F.explode(names).alias("period"))


def rolling_periods(begin_year: int, end_year: int, width: int, step: int):
    """Overlapping (name, begin, end) periods of ``width`` years every ``step`` years."""
    return [
        (f"{y}-{y + width - 1}", f"{y}-01-01", f"{y + width - 1}-12-31")
        for y in range(begin_year, end_year + 1, step)
    ]


