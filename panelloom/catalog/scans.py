"""Scans, sinks and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bins import discretize_by_month
from ..operators.returns import calculate_diff_ir, calculate_return
from ..operators.splits import date_range, with_split
from ..plans.panels import SUPPLIERS, supplier_panel, table
from ..session import staging_path
from ..sources.commits import fingerprint, read_or_compute
from ..sources.readers import read_models, read_panel
from ..sources.writers import wide_export, write_panel, write_results
from .base import Register, SUPPLIERS_SQL, bin_sql, returns_sql, spread_sql

ENTRIES = Register()
COLUMNS = SUPPLIERS.columns()
PANEL_SQL = f"""WITH {SUPPLIERS_SQL}
SELECT month, sec, x1, x2, fq_ret, fm_ret, sector, CAST(member AS DOUBLE) AS member FROM panel"""
TEST_BEGIN, TEST_END = "1999-01-01", "2001-12-31"


def _backtest(spark, sf_dir, factor, keys=("split",)):
    panel = supplier_panel(spark, sf_dir)
    ranked = discretize_by_month(panel, [factor], 5, "month", ["sec"], suffix="rank")
    split = with_split(ranked, "month", TEST_BEGIN, TEST_END)
    return calculate_return(split, "month", f"{factor}_rank", range(5), "fm_ret", list(keys))


def _backtest_sql(factor, prefix=""):
    return (
        bin_sql("panel", f"{prefix}binned", {"cls": (factor, 5)}, "month", "sec")
        + f""",
{prefix}split AS (SELECT *, CASE WHEN month BETWEEN DATE '{TEST_BEGIN}' AND DATE '{TEST_END}'
  THEN 'test' ELSE 'train' END AS split FROM {prefix}binned
  WHERE month <= DATE '{TEST_END}'),
"""
        + returns_sql(f"{prefix}split", prefix, "cls", range(5), "fm_ret", "split")
    )


@ENTRIES.add("s1_csv_panel_scan", PANEL_SQL)
def _(spark, sf_dir):
    path = staging_path(spark, "panel-csv")
    supplier_panel(spark, sf_dir).select(*COLUMNS).write.option("header", True).csv(path)
    return read_panel(spark, path, SUPPLIERS, "csv")


@ENTRIES.add("s2_scan_without_index_column", PANEL_SQL)
def _(spark, sf_dir):
    path = staging_path(spark, "indexed-csv")
    indexed = supplier_panel(spark, sf_dir).select(
        F.monotonically_increasing_id().alias("index"), *COLUMNS
    )
    indexed.write.option("header", True).csv(path)
    return read_panel(spark, path, SUPPLIERS, "csv", index_column="index")


@ENTRIES.add(
    "s1_pruned_panel_scan",
    f"""WITH {SUPPLIERS_SQL} SELECT month, sec, x1, x2, fq_ret, fm_ret, sector, CAST(member AS DOUBLE) AS member FROM panel
    WHERE month BETWEEN DATE '1997-03-01' AND DATE '1997-08-31'""",
)
def _(spark, sf_dir):
    path = staging_path(spark, "panel-parquet")
    stored = supplier_panel(spark, sf_dir).select(*COLUMNS).withColumn("member", F.col("member").cast("double"))
    stored.write.parquet(path)
    return read_panel(spark, path, SUPPLIERS, begin="1997-03-15", end="1997-08-02")


@ENTRIES.add(
    "s1_parquet_panel_by_year",
    f"""WITH {SUPPLIERS_SQL} SELECT month, sec, x1, x2 FROM panel
    WHERE month BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'""",
)
def _(spark, sf_dir):
    path = staging_path(spark, "panel-by-year")
    write_panel(supplier_panel(spark, sf_dir), path, "month")
    stored = spark.read.parquet(path)
    in_range = (F.col("year").between(1997, 1998)) & F.col("month").between("1997-01-01", "1998-06-30")
    return stored.where(in_range).select("month", "sec", "x1", "x2")


@ENTRIES.add(
    "s3_results_of_several_models",
    f"""WITH {SUPPLIERS_SQL}, {_backtest_sql("x1")}
    SELECT 'x1' AS model, split, month, cls, cumulative_return FROM cum""",
    ["cumulative_return"],
)
def _(spark, sf_dir):
    path = staging_path(spark, "models")
    for factor in ("x1", "x2"):
        cum = _backtest(spark, sf_dir, factor).withColumnRenamed(f"{factor}_rank", "cls")
        write_results({"cum_return": cum}, path, factor)
    found = read_models(spark, f"{path}/cum_return", ["x1", "never_run"])
    return found.select("model", "split", "month", "cls", "cumulative_return")


@ENTRIES.add(
    "s4_result_sink",
    f"""WITH {SUPPLIERS_SQL}, {_backtest_sql("x2")}, {spread_sql("", 4, 0, "split")}
    SELECT 'x2' AS model, * FROM spread""",
    ["cumulative_return_diff", "annual_return_diff", "std_diff", "IR"],
)
def _(spark, sf_dir):
    path = staging_path(spark, "results")
    cum = _backtest(spark, sf_dir, "x2").withColumnRenamed("x2_rank", "cls")
    diff = calculate_diff_ir(cum, "month", "cls", 4, 0, "fm_ret", ["split"])
    write_results({"cum_return": cum, "backtest_diff": diff}, path, "x2")
    return spark.read.parquet(f"{path}/backtest_diff")


@ENTRIES.add(
    "s5_cached_result",
    f"WITH {SUPPLIERS_SQL} SELECT month, avg(fm_ret) AS fm_ret FROM panel GROUP BY month",
    ["fm_ret"],
)
def _(spark, sf_dir):
    path = staging_path(spark, "cached")
    panel = supplier_panel(spark, sf_dir)

    def compute():
        return panel.groupBy("month").agg(F.avg("fm_ret").alias("fm_ret"))

    mark = fingerprint({"what": "mean return"}, panel)
    read_or_compute(spark, path, compute, read_last=False, mark=mark)
    return read_or_compute(spark, path, compute, read_last=True, mark=mark)


def _wide_sql():
    parts = ", ".join(
        f'max(CASE WHEN cls = {c} THEN {m} END) AS "{c}_{m}"'
        for c in range(5)
        for m in ("cumulative_return", "annual_return")
    )
    return f"""WITH {SUPPLIERS_SQL}, {_backtest_sql("x1")}
    SELECT month, {parts} FROM cum WHERE split = 'test' GROUP BY month"""


@ENTRIES.add(
    "s6_wide_export",
    _wide_sql(),
    [f"{c}_{m}" for c in range(5) for m in ("cumulative_return", "annual_return")],
)
def _(spark, sf_dir):
    cum = _backtest(spark, sf_dir, "x1").where("split = 'test'")
    return wide_export(cum, "month", "x1_rank", range(5), ["cumulative_return", "annual_return"])


@ENTRIES.add(
    "p2_date_range_filter",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""",
)
def _(spark, sf_dir):
    rows = date_range(table(spark, sf_dir, "lineitem"), "l_shipdate", "1997-01-01", "1997-06-30")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")

