"""Panel scans: text or Parquet, one folder of results per model, cached results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..panel import Panel


def read_panel(
    spark: SparkSession,
    path: str,
    panel: Panel,
    fmt: str = "parquet",
    index_column: str | None = None,
    date_format: str = "yyyy-MM-dd",
    begin: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Scan a panel with its explicit schema; a stored index column is dropped.

    Columns are named in the schema, so no pass is spent on inference and a missing
    column fails at once. ``begin`` and ``end`` name the first and the last month wanted; they
    compare the stored date itself, so they reach the files, which a filter on the truncated
    date would not.
    """
    if fmt == "csv":
        fields = list(panel.schema().fields)
        if index_column is not None:
            fields.insert(0, T.StructField(index_column, T.StringType()))
        options = {"header": True, "dateFormat": date_format, "enforceSchema": False}
        df = spark.read.schema(T.StructType(fields)).options(**options).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if index_column is not None:
        df = df.drop(index_column)
    if begin is not None:
        df = df.where(F.col(panel.date) >= F.trunc(F.lit(begin).cast("date"), "month"))
    if end is not None:
        df = df.where(F.col(panel.date) < F.add_months(F.trunc(F.lit(end).cast("date"), "month"), 1))
    return panel.normalise(panel.check(df))


def read_models(
    spark: SparkSession, path: str, models: Sequence[str], model: str = "model"
) -> DataFrame:
    """Results of several models, tagged by the partition column; absent ones are skipped."""
    return spark.read.parquet(path).where(F.col(model).isin(list(models)))
