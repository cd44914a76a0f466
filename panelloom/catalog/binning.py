"""Quantile classes and the rules built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, rules
from ..operators.bins import discretize_by_month, discretize_by_value, rank_predictions
from ..plans.panels import ROW_KEY, row_panel, supplier_panel
from .base import ROW_TIES, ROWS_SQL, SUPPLIERS_SQL, Register, bin_sql
from .joins import binned
from .summaries import _tertiles

ENTRIES = Register()
ROW_BINS = bin_sql("rows_", "binned", {"qty_bin": ("qty", 5), "price_bin": ("price", 5)}, "month", ROW_TIES)


@ENTRIES.add("w1_monthly_bins", f"WITH {ROWS_SQL}, {ROW_BINS} SELECT {ROW_TIES}, qty_bin, price_bin FROM binned")
def _(spark, sf_dir):
    out = discretize_by_month(row_panel(spark, sf_dir), ["qty", "price"], 5, "month", ROW_KEY, suffix="bin")
    return out.select(*ROW_KEY, "qty_bin", "price_bin")


@ENTRIES.add(
    "w1_monthly_bins_by_selection", f"WITH {ROWS_SQL}, {ROW_BINS} SELECT {ROW_TIES}, qty_bin, price_bin FROM binned"
)
def _(spark, sf_dir):
    # The way taken for months too large for one task, over the whole table.
    out = discretize_by_month(
        row_panel(spark, sf_dir), ["qty", "price"], 5, "month", ROW_KEY, suffix="bin", hot_rows=0
    )
    return out.select(*ROW_KEY, "qty_bin", "price_bin")


@ENTRIES.add(
    "w1_named_bins",
    f"""WITH {SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'b': ('fq_ret', 3)}, 'month', 'sec')}
    SELECT month, sec, ['T3', 'T2', 'T1'][b + 1] AS fq_ret_discrete FROM binned""",
)
def _(spark, sf_dir):
    out = discretize_by_month(
        supplier_panel(spark, sf_dir), ["fq_ret"], 3, "month", ["sec"], ["T3", "T2", "T1"]
    )
    return out.select("month", "sec", "fq_ret_discrete")


@ENTRIES.add(
    "w2_value_bins",
    f"""WITH {ROWS_SQL}, e AS (SELECT quantile_cont(price, 0.25) AS a, median(price) AS b,
      quantile_cont(price, 0.75) AS c FROM rows_)
    SELECT {ROW_TIES}, CAST((price > a)::INT + (price > b)::INT + (price > c)::INT AS INTEGER) AS cls FROM rows_, e""",
)
def _(spark, sf_dir):
    out = discretize_by_value(row_panel(spark, sf_dir), "price", 4, output="cls")
    return out.select(*ROW_KEY, "cls")


@ENTRIES.add(
    "w3_prediction_rank",
    f"""WITH {SUPPLIERS_SQL}, p AS (SELECT *, x1 - x2 AS pred FROM panel),
    {bin_sql('p', 'binned', {'pred_rank': ('pred', 10)}, 'month', 'sec')} SELECT month, sec, pred_rank FROM binned""",
)
def _(spark, sf_dir):
    pred = supplier_panel(spark, sf_dir).withColumn("pred", F.col("x1") - F.col("x2"))
    return rank_predictions(pred, 10, "month", ["sec"]).select("month", "sec", "pred_rank")


def _rule_rows(spark, sf_dir):
    rows = binned(spark, sf_dir, ("x1", "x2"), 3)
    return rows.withColumnsRenamed({"x1_bin": "x1_tertile", "x2_bin": "x2_tertile"})


BOUNDS = """b AS (SELECT max(CASE WHEN feature = 'x1' THEN lower_bound END) AS lo1,
  max(CASE WHEN feature = 'x1' THEN upper_bound END) AS hi1,
  max(CASE WHEN feature = 'x2' THEN upper_bound END) AS hi2 FROM bounds)"""


@ENTRIES.add(
    "m9_single_factor_rule",
    f"""WITH {_tertiles()}, {BOUNDS} SELECT month, sec,
    CASE WHEN x1 < lo1 THEN 0 WHEN x1 < hi1 THEN 1 ELSE 2 END AS pred FROM panel, b""",
)
def _(spark, sf_dir):
    rows = _rule_rows(spark, sf_dir)
    bounds = profile.tertile_boundary(rows, ["x1"])
    return rules.sort_rule(rows, bounds, "x1").select("month", "sec", "pred")


@ENTRIES.add(
    "m10_two_factor_rule",
    f"""WITH {_tertiles()}, {BOUNDS} SELECT month, sec, CASE WHEN x1 < lo1 AND x2 < hi2 THEN 0
    WHEN x1 > hi1 AND x2 < hi2 THEN 2 ELSE 1 END AS pred FROM panel, b""",
)
def _(spark, sf_dir):
    rows = _rule_rows(spark, sf_dir)
    bounds = profile.tertile_boundary(rows, ["x1", "x2"])
    return rules.two_factor_rule(rows, bounds, "x1", "x2").select("month", "sec", "pred")


@ENTRIES.add(
    "m10_two_factor_rule_exact",
    f"""WITH {_tertiles()} SELECT month, sec, CASE WHEN t1 = 0 AND t2 <> 0 THEN 0
    WHEN t1 = 2 AND t2 <> 0 THEN 2 ELSE 1 END AS pred FROM binned""",
)
def _(spark, sf_dir):
    rows = _rule_rows(spark, sf_dir)
    return rules.two_factor_rule_exact(rows, "x1_tertile", "x2_tertile").select("month", "sec", "pred")
