"""Panels derived from the order and shipment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..panel import Panel

# Unique together in every line table.
ROW_KEY = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
)
ROWS = Panel("month", ROW_KEY, ("qty", "price"), label_fm="fm_ret")
SUPPLIERS = Panel(
    "month", ("sec",), ("x1", "x2"), label_reg="fq_ret", label_fm="fm_ret", sector="sector",
    extra=("member",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a security-month row; the forward return is discount minus tax."""
    return table(spark, sf_dir, "lineitem").select(
        F.trunc("l_shipdate", "month").alias("month"),
        *ROW_KEY,
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") - F.col("l_tax")).alias("fm_ret"),
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (month, supplier); sums are whole numbers, so any order of adding
    gives the same values."""
    n = F.count(F.lit(1))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    points = F.sum(F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("bigint"))
    base = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sec"), F.trunc("l_shipdate", "month").alias("month"))
        .agg(
            (F.sum("l_quantity") / n).alias("x1"),
            (cents / (n * 100000.0)).alias("x2"),
            (points / (n * 100.0)).alias("fm_ret"),
            n.alias("n_rows"),
        )
    )
    # One row per supplier and month, so this window orders a calendar.
    own = W.partitionBy("sec").orderBy("month")
    ahead = [F.lead("fm_ret", i).over(own) for i in (1, 2, 3)]
    base = base.withColumn("fq_ret", ahead[0] + ahead[1] + ahead[2])
    info = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sec"),
        F.col("s_nationkey").cast("int").alias("sector"),
        (F.col("s_acctbal") > 0).cast("int").alias("member"),
    )
    return base.join(info, "sec")


def market_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order values: one row per month."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("month"))
        .agg(
            (F.sum(cents) / (F.count(F.lit(1)) * 1e7)).alias("level"),
            (F.max(cents) / 1e7).alias("high"),
            (F.min(cents) / 1e7).alias("low"),
        )
    )
