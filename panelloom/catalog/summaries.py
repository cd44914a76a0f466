"""Profiles, one- and two-way summaries, quantiles and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..operators.order_stats import quantiles
from ..operators.returns import calculate_diff_ir, calculate_return, latest_row
from ..operators.splits import in_periods
from ..plans.panels import row_panel, supplier_panel
from .base import ROWS_SQL, SUPPLIERS_SQL, Register, bin_sql, returns_sql, spread_sql
from .cleaning import GAPS_SQL, row_gaps
from .joins import PERIODS, _periods_sql, binned

ENTRIES = Register()
TWO = f"{SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'b1': ('x1', 5), 'b2': ('x2', 5)}, 'month', 'sec')}"


def two_bins(spark, sf_dir, n=5):
    rows = binned(spark, sf_dir, ("x1", "x2"), n)
    return rows.withColumnsRenamed({"x1_bin": "b1", "x2_bin": "b2"})


def _share_sql(test, by=""):
    k = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, avg(CASE WHEN {test.format(c=c)} THEN 1.0 ELSE 0.0 END) AS share FROM gaps{group}"
        for c in ("qty", "price", "fm_ret")
    )


@ENTRIES.add("a1_null_share", f"WITH {GAPS_SQL} {_share_sql('{c} IS NULL')}", ["share"])
def _(spark, sf_dir):
    out = profile.count_null(row_gaps(spark, sf_dir), ["qty", "price", "fm_ret"])
    return out.withColumnRenamed("null_share", "share")


@ENTRIES.add("a2_null_share_by_month", f"WITH {GAPS_SQL} {_share_sql('{c} IS NULL', 'month')}", ["share"])
def _(spark, sf_dir):
    out = profile.count_null(row_gaps(spark, sf_dir), ["qty", "price", "fm_ret"], ["month"])
    return out.withColumnRenamed("null_share", "share")


@ENTRIES.add(
    "a3_inf_share_by_month", f"WITH {GAPS_SQL} " + _share_sql("{c} = CAST('inf' AS DOUBLE)", "month"), ["share"]
)
def _(spark, sf_dir):
    out = profile.count_inf(row_gaps(spark, sf_dir), ["qty", "price", "fm_ret"], ["month"])
    return out.withColumnRenamed("inf_share", "share")


@ENTRIES.add(
    "a4_zero_share",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} = 0) AS n_zero,
        count(*) FILTER (WHERE {c} = 0) / CAST(count(*) AS DOUBLE) AS zero_share FROM lineitem"""
        for c in ("l_discount", "l_tax")
    ),
    ["zero_share"],
)
def _(spark, sf_dir):
    from ..plans.panels import table

    return profile.count_zero(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])


@ENTRIES.add(
    "a5_statistics_by_dataset",
    f"WITH {ROWS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT l_linenumber % 3 AS part, '{c}' AS feature, avg({c}) AS mean, median({c}) AS median,
        stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM rows_ GROUP BY 1"""
        for c in ("qty", "fm_ret")
    ),
    ["mean", "median", "std", "min", "max"],
)
def _(spark, sf_dir):
    rows = row_panel(spark, sf_dir).withColumn("part", F.col("l_linenumber") % 3)
    return profile.statistics(rows, ["part"], ["qty", "fm_ret"])


@ENTRIES.add(
    "a6_mean_by_month_and_class",
    f"WITH {TWO} SELECT month, b1, avg(fm_ret) AS fm_ret FROM binned GROUP BY ALL",
    ["fm_ret"],
)
def _(spark, sf_dir):
    return profile.group_mean(two_bins(spark, sf_dir), ["month", "b1"], "fm_ret")


@ENTRIES.add(
    "a7_two_way_mean", f"WITH {TWO} SELECT b1, b2, avg(fm_ret) AS fm_ret FROM binned GROUP BY ALL", ["fm_ret"]
)
def _(spark, sf_dir):
    return profile.group_mean(two_bins(spark, sf_dir), ["b1", "b2"], "fm_ret")


def _margins(columns):
    return f"""WITH {TWO} SELECT coalesce(CAST(b1 AS VARCHAR), 'All') AS bin_x,
    coalesce(CAST(b2 AS VARCHAR), 'All') AS bin_y, {columns} FROM binned GROUP BY CUBE (b1, b2)"""


@ENTRIES.add(
    "a8_two_way_table_with_margins",
    _margins("avg(fm_ret) AS mean, median(fm_ret) AS median, count(fm_ret) AS n"),
    ["mean", "median"],
)
def _(spark, sf_dir):
    out = profile.two_way_table(two_bins(spark, sf_dir), "b1", "b2", "fm_ret")
    return out.select("bin_x", "bin_y", "mean", "median", "n")


@ENTRIES.add(
    "a9_standard_error_with_margins",
    _margins(
        "2 * stddev_samp(fm_ret) / sqrt(count(fm_ret)) AS mean_err, "
        "2 * stddev_samp(fm_ret) / sqrt(count(fm_ret)) * sqrt(pi() / 2) AS median_err"
    ),
    ["mean_err", "median_err"],
)
def _(spark, sf_dir):
    out = profile.two_way_table(two_bins(spark, sf_dir), "b1", "b2", "fm_ret", 2.0)
    return out.select("bin_x", "bin_y", "mean_err", "median_err")


@ENTRIES.add(
    "a10_sample_counts",
    f"""WITH {TWO}, c AS (SELECT b1, b2, month, count(*) AS n FROM binned GROUP BY ALL)
    SELECT n AS size, count(*) AS cells FROM c GROUP BY 1""",
)
def _(spark, sf_dir):
    counts = profile.count_by(two_bins(spark, sf_dir), ["b1", "b2", "month"])
    return profile.count_by(counts.withColumnRenamed("n", "size"), ["size"], "cells")


@ENTRIES.add("a11_class_contingency", f"WITH {TWO} SELECT member, b1, b2, count(*) AS n FROM binned GROUP BY ALL")
def _(spark, sf_dir):
    return profile.count_by(two_bins(spark, sf_dir), ["member", "b1", "b2"])


@ENTRIES.add(
    "a12_mean_std_by_sector",
    f"""WITH {TWO} SELECT sector, b1, b2, avg(fm_ret) AS mean, stddev_samp(fm_ret) AS std, count(fm_ret) AS n
    FROM binned GROUP BY ALL""",
    ["mean", "std"],
)
def _(spark, sf_dir):
    return profile.mean_std_by(two_bins(spark, sf_dir), ["sector", "b1", "b2"], "fm_ret")


@ENTRIES.add(
    "a13_period_mean_median",
    f"""WITH {TWO}, p AS (FROM (VALUES {_periods_sql()}) t(period, b, e))
    SELECT period, b1, avg(fm_ret) AS mean, median(fm_ret) AS median, count(fm_ret) AS n
    FROM binned JOIN p ON month BETWEEN b AND e WHERE b1 IN (0, 4) GROUP BY ALL""",
    ["mean", "median"],
)
def _(spark, sf_dir):
    ends = two_bins(spark, sf_dir).where("b1 in (0, 4)")
    return profile.mean_median_by(in_periods(ends, "month", PERIODS), ["period", "b1"], "fm_ret")


@ENTRIES.add(
    "a14_correlation_matrix",
    f"WITH {SUPPLIERS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS corr FROM panel"
        for a in ("x1", "x2", "fq_ret")
        for b in ("x1", "x2", "fq_ret")
    ),
    ["corr"],
)
def _(spark, sf_dir):
    return profile.correlation_matrix(supplier_panel(spark, sf_dir), ["x1", "x2", "fq_ret"])


def _exposure_sql(n):
    bins = bin_sql("panel", f"e{n}", {f"b1_{n}": ("x1", n), f"b2_{n}": ("x2", n)}, "month", "sec")
    return f"""{bins}, x{n} AS (SELECT month,
      avg(CASE WHEN b1_{n} = {n - 1} THEN x1 END) - avg(CASE WHEN b1_{n} = 0 THEN x1 END) AS x1,
      avg(CASE WHEN b2_{n} = {n - 1} THEN x2 END) - avg(CASE WHEN b2_{n} = 0 THEN x2 END) AS x2
      FROM e{n} GROUP BY 1)"""


@ENTRIES.add(
    "a15_factor_exposure_correlation",
    f"WITH {SUPPLIERS_SQL}, {', '.join(_exposure_sql(n) for n in (3, 5, 10))} "
    + " UNION ALL ".join(f"SELECT {n} AS n_classes, corr(x1, x2) AS corr FROM x{n}" for n in (3, 5, 10)),
    ["corr"],
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    out = None
    for n in (3, 5, 10):
        exposure = profile.factor_exposure(panel, "month", ["x1", "x2"], n, ["sec"])
        corr = profile.correlation_matrix(exposure, ["x1", "x2"]).where("x = 'x1' and y = 'x2'")
        part = corr.select(F.lit(n).alias("n_classes"), "corr")
        out = part if out is None else out.unionByName(part)
    return out


@ENTRIES.add(
    "a16_class_share",
    f"""WITH {TWO} SELECT sector, b1, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY sector) AS share
    FROM binned GROUP BY sector, b1""",
    ["share"],
)
def _(spark, sf_dir):
    return profile.value_share(two_bins(spark, sf_dir), "b1", ["sector"])


def _tertiles():
    return f"""{SUPPLIERS_SQL},
    {bin_sql('panel', 'binned', {'t1': ('x1', 3), 't2': ('x2', 3)}, 'month', 'sec')},
    ends AS (SELECT 'x1' AS feature, t1 AS c, min(x1) AS lo, max(x1) AS hi FROM binned GROUP BY ALL
      UNION ALL SELECT 'x2', t2, min(x2), max(x2) FROM binned GROUP BY ALL),
    sorted AS (SELECT feature, list_sort(list(lo)) AS lo, list_sort(list(hi)) AS hi FROM ends GROUP BY 1),
    bounds AS (SELECT feature, (lo[2] + hi[1]) / 2 AS lower_bound, (lo[3] + hi[2]) / 2 AS upper_bound FROM sorted)"""


@ENTRIES.add("a17_tertile_boundary", f"WITH {_tertiles()} SELECT * FROM bounds", ["lower_bound", "upper_bound"])
def _(spark, sf_dir):
    rows = two_bins(spark, sf_dir, 3).withColumnsRenamed({"b1": "x1_tertile", "b2": "x2_tertile"})
    return profile.tertile_boundary(rows, ["x1", "x2"])


@ENTRIES.add(
    "a18_exact_quantiles",
    f"""WITH {ROWS_SQL} SELECT month, quantile_cont(price, 0.25) AS q1, median(price) AS q2,
    quantile_cont(price, 0.75) AS q3 FROM rows_ GROUP BY 1""",
    ["q1", "q2", "q3"],
)
def _(spark, sf_dir):
    # By selection, as for months that no task could hold.
    q = quantiles(row_panel(spark, sf_dir), ["month"], ["price"], [0.25, 0.5, 0.75], hot_rows=0)
    return q.select("month", *[F.col("q_price")[i].alias(f"q{i + 1}") for i in range(3)])


@ENTRIES.add(
    "a19_distinct_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for c in ("l_quantity", "l_suppkey", "l_returnflag")
    ),
)
def _(spark, sf_dir):
    from ..plans.panels import table

    return profile.distinct_count(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_suppkey", "l_returnflag"])


SPREAD = f"""{SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'cls': ('x1', 5)}, 'month', 'sec')},
{returns_sql('binned', '', 'cls', range(5), 'fm_ret', 'member')}, {spread_sql('', 4, 0, 'member')}"""
SPREAD_COLUMNS = ["cumulative_return_diff", "annual_return_diff", "std_diff", "IR"]


def _member_spread(spark, sf_dir):
    cum = calculate_return(binned(spark, sf_dir), "month", "x1_bin", range(5), "fm_ret", ["member"])
    return calculate_diff_ir(cum, "month", "x1_bin", 4, 0, "fm_ret", ["member"])


@ENTRIES.add("t1_sorted_spread", f"WITH {SPREAD} SELECT * FROM spread ORDER BY member, month", SPREAD_COLUMNS)
def _(spark, sf_dir):
    return _member_spread(spark, sf_dir).orderBy("member", "month")


@ENTRIES.add(
    "t2_latest_spread",
    f"WITH {SPREAD} SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY member ORDER BY month DESC) = 1",
    SPREAD_COLUMNS,
)
def _(spark, sf_dir):
    return latest_row(_member_spread(spark, sf_dir), "month", ["member"])


@ENTRIES.add(
    "t3_best_row",
    f"""WITH {SUPPLIERS_SQL} SELECT month, sec, x1 FROM panel
    QUALIFY row_number() OVER (PARTITION BY month ORDER BY x1 DESC, sec) = 1""",
)
def _(spark, sf_dir):
    return profile.argmax_row(supplier_panel(spark, sf_dir), "sec", "x1", ["month"])
