"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, date: str) -> None:
    """Partition a panel by year so that date ranges prune folders."""
    df.withColumn("year", F.year(date)).write.mode("overwrite").partitionBy("year").parquet(path)


def write_results(results: dict[str, DataFrame], root: str, model: str, fmt: str = "parquet"):
    """One table per result below ``root``, partitioned by model, and by split if present.

    A model only replaces its own partition.
    """
    for name, df in results.items():
        parts = ["model"] + (["split"] if "split" in df.columns else [])
        writer = df.withColumn("model", F.lit(model)).write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{root.rstrip('/')}/{name}")


def wide_export(
    df: DataFrame, date: str, cls: str, classes: Sequence, measures: Sequence[str]
) -> DataFrame:
    """One row per date, one column per class and measure."""
    return df.groupBy(date).pivot(cls, list(classes)).agg(
        *[F.first(m, ignorenulls=True).alias(m) for m in measures]
    )
