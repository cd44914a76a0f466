"""Joins, unions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, returns, rolling
from ..operators.bins import discretize_by_month
from ..operators.splits import expand_grid, grid_table, in_periods, rolling_periods
from ..plans.panels import market_series, row_panel, supplier_panel, table
from ..plans.reports import stack_frames
from .base import MARKET_SQL, ROWS_SQL, SUPPLIERS_SQL, Register, bin_sql, returns_sql, spread_sql

ENTRIES = Register()
PERIODS = rolling_periods(1995, 2000, 3, 2)
BINNED = f"{SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'b1': ('x1', 5)}, 'month', 'sec')}"


def binned(spark, sf_dir, variables=("x1",), n=5):
    return discretize_by_month(
        supplier_panel(spark, sf_dir), list(variables), n, "month", ["sec"], suffix="bin"
    )


@ENTRIES.add(
    "j1_return_with_error",
    f"""WITH {BINNED} SELECT month, b1, avg(fm_ret) AS ret, stddev_samp(fm_ret) / sqrt(count(fm_ret)) AS err
    FROM binned GROUP BY ALL""",
    ["ret", "err"],
)
def _(spark, sf_dir):
    rows = binned(spark, sf_dir).withColumnRenamed("x1_bin", "b1")
    ret = profile.group_mean(rows, ["month", "b1"], "fm_ret", "ret")
    err = rows.groupBy("month", "b1").agg(
        profile.standard_error(F.stddev_samp("fm_ret"), F.count("fm_ret")).alias("err")
    )
    return ret.join(err, ["month", "b1"], "inner")


@ENTRIES.add(
    "j2_market_joined_on_month",
    f"""WITH {SUPPLIERS_SQL}, {MARKET_SQL},
    flag AS (SELECT month, avg(fm_ret) AS m FROM panel GROUP BY 1)
    SELECT month, level, m FROM market LEFT JOIN flag USING (month) WHERE m IS NOT NULL""",
    ["level", "m"],
)
def _(spark, sf_dir):
    flag = supplier_panel(spark, sf_dir).groupBy("month").agg(F.avg("fm_ret").alias("m"))
    market = market_series(spark, sf_dir).select("month", "level")
    return market.join(flag, "month", "left").na.drop()


@ENTRIES.add(
    "j3_top_minus_bottom",
    f"""WITH {BINNED} SELECT month, avg(CASE WHEN b1 = 4 THEN fm_ret END)
    - avg(CASE WHEN b1 = 0 THEN fm_ret END) AS spread FROM binned GROUP BY 1""",
    ["spread"],
)
def _(spark, sf_dir):
    return returns.monthly_spread(binned(spark, sf_dir), "month", "x1_bin", 4, 0, "fm_ret")


def _sector_cte():
    return f"""WITH {SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'cls': ('x1', 3)}, 'month', 'sec')},
    small AS (SELECT * REPLACE (sector % 5 AS sector) FROM binned),
    {returns_sql('small', '', 'cls', range(3), 'fm_ret', 'sector')},
    {spread_sql('', 2, 0, 'sector')}"""


def _sector_spread(spark, sf_dir):
    rows = binned(spark, sf_dir, n=3).withColumn("sector", F.col("sector") % 5)
    return returns.sector_spreads(rows, "month", "x1_bin", range(3), "fm_ret", 2, 0, "sector")


@ENTRIES.add(
    "l5_spread_by_sector",
    f"{_sector_cte()} SELECT sector, month, cumulative_return_diff FROM spread",
    ["cumulative_return_diff"],
)
def _(spark, sf_dir):
    return _sector_spread(spark, sf_dir)


@ENTRIES.add(
    "j4_sector_spreads_side_by_side",
    f"""{_sector_cte()} SELECT month, """
    + ", ".join(f'max(CASE WHEN sector = {s} THEN cumulative_return_diff END) AS "{s}"' for s in range(5))
    + " FROM spread GROUP BY 1",
    [str(s) for s in range(5)],
)
def _(spark, sf_dir):
    return returns.widen(
        _sector_spread(spark, sf_dir), ["month"], "sector", range(5), "cumulative_return_diff"
    )


@ENTRIES.add(
    "j6_previous_month_state",
    f"""WITH {SUPPLIERS_SQL} SELECT a.month, a.sec, a.fm_ret, b.fm_ret AS previous
    FROM panel a LEFT JOIN panel b ON b.sec = a.sec AND b.month = a.month - INTERVAL 1 MONTH""",
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir).select("month", "sec", "fm_ret")
    before = panel.select(
        F.add_months("month", 1).alias("month"), "sec", F.col("fm_ret").alias("previous")
    )
    return panel.join(before, ["month", "sec"], "left")


@ENTRIES.add(
    "j7_semi_join",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
)
def _(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(chosen, orders.o_custkey == chosen.c_custkey, "left_semi")


@ENTRIES.add(
    "j8_anti_join",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)""",
)
def _(spark, sf_dir):
    dropped = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(dropped, orders.o_custkey == dropped.c_custkey, "left_anti")


@ENTRIES.add(
    "j10_parameter_product",
    """SELECT p_partkey, CAST(a AS INTEGER) * 3 + CAST(b AS INTEGER) AS model_id, p_retailprice * alpha + depth AS score
    FROM part, (VALUES (0, 0.1), (1, 1.0)) x(a, alpha), (VALUES (0, 2), (1, 3), (2, 4)) y(b, depth)
    WHERE p_size = 1""",
    ["score"],
)
def _(spark, sf_dir):
    grid = expand_grid({"alpha": [0.1, 1.0], "depth": [2, 3, 4]})
    sets = F.array(
        *[
            F.struct(F.lit(i).alias("model_id"), F.lit(p["alpha"]).alias("a"), F.lit(p["depth"]).alias("d"))
            for i, p in enumerate(grid)
        ]
    )
    parts = table(spark, sf_dir, "part").where("p_size = 1")
    return parts.select("p_partkey", "p_retailprice", F.explode(sets).alias("s")).select(
        "p_partkey", "s.model_id", (F.col("p_retailprice") * F.col("s.a") + F.col("s.d")).alias("score")
    )


def _periods_sql():
    return ", ".join(f"('{n}', DATE '{b}', DATE '{e}')" for n, b, e in PERIODS)


@ENTRIES.add(
    "j11_overlapping_periods",
    f"""WITH {ROWS_SQL}, p AS (FROM (VALUES {_periods_sql()}) t(period, b, e))
    SELECT period, count(*) AS n, sum(qty) AS qty FROM rows_ JOIN p ON month BETWEEN b AND e GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = in_periods(row_panel(spark, sf_dir), "month", PERIODS)
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@ENTRIES.add(
    "j12_dense_classes",
    f"""WITH {SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'cls': ('x1', 10)}, 'month', 'sec')},
    part_ AS (SELECT * FROM binned WHERE (month(month) + cls) % 4 <> 0),
    {returns_sql('part_', '', 'cls', range(10), 'fm_ret')} SELECT month, cls, ret FROM dense""",
    ["ret"],
)
def _(spark, sf_dir):
    rows = binned(spark, sf_dir, n=10).withColumnRenamed("x1_bin", "cls")
    some = rows.where((F.month("month") + F.col("cls")) % 4 != 0)
    means = returns.class_returns(some, "month", "cls", "fm_ret")
    dense = returns.complete_classes(means, "month", "cls", range(10), "fm_ret")
    return dense.withColumnRenamed("fm_ret", "ret")


@ENTRIES.add(
    "u1_union_all",
    f"""WITH {ROWS_SQL}, {SUPPLIERS_SQL} SELECT 'rows' AS source, month, fm_ret AS v, CAST(NULL AS DOUBLE) AS sector FROM rows_
    UNION ALL SELECT 'suppliers', month, fm_ret, CAST(sector AS DOUBLE) FROM panel""",
)
def _(spark, sf_dir):
    rows = row_panel(spark, sf_dir).select(F.lit("rows").alias("source"), "month", F.col("fm_ret").alias("v"))
    suppliers = supplier_panel(spark, sf_dir).select(
        F.lit("suppliers").alias("source"), "month", F.col("fm_ret").alias("v"), F.col("sector").cast("double")
    )
    return rows.unionByName(suppliers, allowMissingColumns=True)


@ENTRIES.add(
    "u2_tagged_union",
    f"""WITH {SUPPLIERS_SQL}, t AS (SELECT CASE member WHEN 1 THEN 'member' ELSE 'other' END AS "Dataset", * FROM panel)
    SELECT "Dataset", 'x1' AS feature, x1 AS "Value" FROM t UNION ALL SELECT "Dataset", 'x2', x2 FROM t""",
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    return stack_frames(
        {"member": panel.where("member = 1"), "other": panel.where("member = 0")}, ["x1", "x2"]
    )


@ENTRIES.add(
    "u3_pivot_by_class",
    f"WITH {BINNED} SELECT month, "
    + ", ".join(f'avg(CASE WHEN b1 = {c} THEN fm_ret END) AS "{c}"' for c in range(5))
    + " FROM binned GROUP BY 1",
    [str(c) for c in range(5)],
)
def _(spark, sf_dir):
    return binned(spark, sf_dir).groupBy("month").pivot("x1_bin", list(range(5))).agg(F.avg("fm_ret"))


@ENTRIES.add(
    "u4_melt",
    f"""WITH {SUPPLIERS_SQL} SELECT month, sec, 'x1' AS feature, x1 AS value FROM panel
    UNION ALL SELECT month, sec, 'fm_ret', fm_ret FROM panel""",
)
def _(spark, sf_dir):
    return supplier_panel(spark, sf_dir).unpivot(["month", "sec"], ["x1", "fm_ret"], "feature", "value")


@ENTRIES.add(
    "d6_parameter_grid",
    """SELECT CAST(a * 2 + b AS INTEGER) AS model_id, n_alpha, n_depth, n FROM
    (VALUES (0, '0.1'), (1, '1.0')) x(a, n_alpha), (VALUES (0, '2'), (1, '4')) y(b, n_depth),
    (SELECT count(*) AS n FROM part) z""",
)
def _(spark, sf_dir):
    grid = grid_table(spark, {"alpha": [0.1, 1.0], "depth": [2, 4]})
    rows = grid.select(
        "model_id", F.col("params")["alpha"].alias("n_alpha"), F.col("params")["depth"].alias("n_depth"),
        F.lit(1).alias("k"),
    )
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return n.join(F.broadcast(rows), "k").drop("k")


@ENTRIES.add(
    "w10_rolling_mean",
    f"""WITH {BINNED}, part_ AS (SELECT * FROM binned WHERE (month(month) + b1) % 11 <> 0),
    m AS (SELECT month, b1, avg(fm_ret) AS v FROM part_ GROUP BY ALL),
    g AS (SELECT a.month, b.b1, m.v FROM (SELECT DISTINCT month FROM m) a, (SELECT DISTINCT b1 FROM m) b
      LEFT JOIN m ON m.month = a.month AND m.b1 = b.b1)
    SELECT month, b1, v, CASE WHEN count(v) OVER w = 6 THEN avg(v) OVER w END AS v_roll FROM g
    WINDOW w AS (PARTITION BY b1 ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    ["v", "v_roll"],
)
def _(spark, sf_dir):
    rows = binned(spark, sf_dir).select("month", F.col("x1_bin").alias("b1"), F.col("fm_ret").alias("v"))
    some = rows.where((F.month("month") + F.col("b1")) % 11 != 0)
    return rolling.rolling_mean(rolling.dense_means(some, "month", "b1", "v"), "month", "v", 6, ["b1"])


@ENTRIES.add(
    "w11_lag_difference",
    f"""WITH {MARKET_SQL} SELECT month, level, level - lag(level, 3) OVER (ORDER BY month) AS level_diff FROM market""",
    ["level", "level_diff"],
)
def _(spark, sf_dir):
    return rolling.lag_difference(
        market_series(spark, sf_dir).select("month", "level"), "month", ["level"], 3
    )


PAIRS = f"""{SUPPLIERS_SQL},
{bin_sql('panel', 'binned', {'b1': ('x1', 5), 'b2': ('x2', 5)}, 'month', 'sec')},
lab AS (SELECT *, concat('x1 ', b1, '; x2 ', b2) AS grp FROM binned),
m AS (SELECT month, grp, avg(fm_ret) AS v FROM lab GROUP BY ALL),
g AS (SELECT a.month, b.grp, m.v FROM (SELECT DISTINCT month FROM m) a, (SELECT DISTINCT grp FROM m) b
  LEFT JOIN m ON m.month = a.month AND m.grp = b.grp),
r AS (SELECT month, grp, CASE WHEN count(v) OVER w = 6 THEN avg(v) OVER w END AS v FROM g
  WINDOW w AS (PARTITION BY grp ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
PARTS = [("x1_Exp", "x1_bin"), ("x2_Exp", "x2_bin")]


@ENTRIES.add(
    "w13_reversal_flag",
    f"""WITH {PAIRS}, s AS (SELECT month, max(CASE WHEN grp = 'x1 4; x2 4' THEN v END)
      - max(CASE WHEN grp = 'x1 0; x2 0' THEN v END) AS spread FROM r GROUP BY 1)
    SELECT month, spread, CAST(coalesce(spread > 0.001, FALSE) AS INTEGER) AS reversal FROM s""",
    ["spread"],
)
def _(spark, sf_dir):
    from ..functions.scalars import group_label

    rows = binned(spark, sf_dir, ("x1", "x2")).withColumn("grp", group_label(PARTS))
    rolled = rolling.rolling_mean(
        rolling.dense_means(rows, "month", "grp", "fm_ret"), "month", "fm_ret", 6, ["grp"]
    )
    return rolling.reversal_flag(
        rolled, "month", "grp", "fm_ret_roll", "x1 4; x2 4", "x1 0; x2 0", 0.001
    )


@ENTRIES.add(
    "l10_two_factor_rolling_return",
    f"""WITH {PAIRS}, {MARKET_SQL},
    e AS (SELECT month, grp, 2 * stddev_samp(fm_ret) / sqrt(count(fm_ret)) AS err FROM lab GROUP BY ALL)
    SELECT month, grp AS "group", v AS fm_ret, err FROM r JOIN e USING (month, grp)
    WHERE v IS NOT NULL AND err IS NOT NULL
    UNION ALL SELECT month, 'level', level, 0 FROM market""",
    ["fm_ret", "err"],
)
def _(spark, sf_dir):
    rows = binned(spark, sf_dir, ("x1", "x2"))
    market = market_series(spark, sf_dir).select("month", "level")
    return rolling.two_factor_rolling(
        rows, "month", PARTS, "fm_ret", 6, 2.0, market, ["level"]
    )
