"""Projections, filters, imputation, scaling, dates and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..operators import clean, profile
from ..operators.splits import hash_number, subsample
from ..plans.panels import ROW_KEY, row_panel, supplier_panel, table
from .base import ROWS_SQL, SUPPLIERS_SQL, Register

ENTRIES = Register()
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
# Rows of line number 7 stand for missing values, those of 6 for infinite ones.
GAPS_SQL = f"""{ROWS_SQL},
gaps AS (SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN NULL ELSE qty END AS qty,
  CASE WHEN l_linenumber = 6 THEN CAST('inf' AS DOUBLE) ELSE price END AS price) FROM rows_)"""
SUPPLIER_GAPS_SQL = f"""{SUPPLIERS_SQL},
gaps AS (SELECT * REPLACE (CASE WHEN (sec + month(month)) % 5 = 0 THEN NULL ELSE x1 END AS x1)
  FROM panel)"""


def row_gaps(spark, sf_dir):
    return row_panel(spark, sf_dir).withColumns(
        {
            "qty": F.when(F.col("l_linenumber") != 7, F.col("qty")),
            "price": F.when(F.col("l_linenumber") == 6, F.lit(float("inf"))).otherwise(F.col("price")),
        }
    )


def supplier_gaps(spark, sf_dir):
    hole = (F.col("sec") + F.month("month")) % 5 == 0
    return supplier_panel(spark, sf_dir).withColumn("x1", F.when(~hole, F.col("x1")))


@ENTRIES.add("p1_project_and_rename", f"WITH {SUPPLIERS_SQL} SELECT month AS date, sec AS security, x1 FROM panel")
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir).drop("x2")
    return panel.withColumnsRenamed({"month": "date", "sec": "security"}).select("date", "security", "x1")


@ENTRIES.add("p3_flag_filter", f"WITH {SUPPLIERS_SQL} SELECT month, sec, member, x1 FROM panel WHERE member = 1")
def _(spark, sf_dir):
    return supplier_panel(spark, sf_dir).where("member = 1").select("month", "sec", "member", "x1")


@ENTRIES.add(
    "p4_remove_missing_targets",
    f"WITH {SUPPLIER_GAPS_SQL} SELECT month, sec, x1, fq_ret FROM gaps WHERE x1 IS NOT NULL AND fq_ret IS NOT NULL",
)
def _(spark, sf_dir):
    kept = clean.remove_missing_targets(supplier_gaps(spark, sf_dir), ["x1", "fq_ret"])
    return kept.select("month", "sec", "x1", "fq_ret")


@ENTRIES.add(
    "p5_drop_infinite",
    f"WITH {GAPS_SQL} SELECT {KEY}, qty, price FROM gaps WHERE price <> CAST('inf' AS DOUBLE)",
)
def _(spark, sf_dir):
    return clean.drop_infinite(row_gaps(spark, sf_dir), ["qty", "price"]).select(*ROW_KEY, "qty", "price")


@ENTRIES.add("p6_impute_by_month", f"WITH {GAPS_SQL} SELECT {KEY}, coalesce(qty, 0) AS qty FROM gaps")
def _(spark, sf_dir):
    return clean.impute_data(row_gaps(spark, sf_dir), "month", ["qty"]).select(*ROW_KEY, "qty")


@ENTRIES.add(
    "p7_forward_fill_by_security",
    f"""WITH {SUPPLIER_GAPS_SQL}
    SELECT month, sec, last_value(x1 IGNORE NULLS) OVER (PARTITION BY sec ORDER BY month
      ROWS UNBOUNDED PRECEDING) AS x1 FROM gaps""",
)
def _(spark, sf_dir):
    filled = clean.impute_data(supplier_gaps(spark, sf_dir), "securityId_ff", ["x1"], "sec", "month")
    return filled.select("month", "sec", "x1")


@ENTRIES.add(
    "p7_running_mean_by_security",
    f"""WITH {SUPPLIER_GAPS_SQL}
    SELECT month, sec, coalesce(x1, avg(x1) OVER (PARTITION BY sec ORDER BY month
      ROWS UNBOUNDED PRECEDING)) AS x1 FROM gaps""",
    ["x1"],
)
def _(spark, sf_dir):
    filled = clean.impute_data(
        supplier_gaps(spark, sf_dir), "securityId_average", ["x1"], "sec", "month"
    )
    return filled.select("month", "sec", "x1")


@ENTRIES.add("p8_negated_features", f'WITH {SUPPLIERS_SQL} SELECT month, sec, -x1 AS "-x1", -x2 AS "-x2" FROM panel')
def _(spark, sf_dir):
    return clean.negate(supplier_panel(spark, sf_dir), ["x1", "x2"]).select("month", "sec", "-x1", "-x2")


@ENTRIES.add(
    "p9_adjusted_edge",
    f"""WITH {SUPPLIERS_SQL} SELECT month, sec, x1 - x2 - fm_ret AS "Edge_Adj",
    fq_ret - (x1 - x2 - fm_ret) AS "Residual" FROM panel""",
    ["Edge_Adj", "Residual"],
)
def _(spark, sf_dir):
    out = clean.adjusted_edge(supplier_panel(spark, sf_dir), "x1", ["x2", "fm_ret"], "fq_ret")
    return out.select("month", "sec", "Edge_Adj", "Residual")


@ENTRIES.add(
    "p10_code_to_sector",
    "SELECT p_partkey, CAST(substr(CAST(45103010 + p_partkey * 1000 AS VARCHAR), 1, 2) AS DOUBLE) AS sector FROM part",
)
def _(spark, sf_dir):
    code = (F.lit(45103010) + F.col("p_partkey") * 1000).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.code_prefix(code).alias("sector"))


@ENTRIES.add(
    "p11_group_label",
    """SELECT l_linenumber, concat('Diff ', l_returnflag, '; PM ', l_linestatus) AS grp, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def _(spark, sf_dir):
    label = scalars.group_label([("Diff_Exp", "l_returnflag"), ("PM_Exp", "l_linestatus")])
    rows = table(spark, sf_dir, "lineitem").withColumn("grp", label)
    return profile.count_by(rows, ["l_linenumber", "grp"])


@ENTRIES.add(
    "p12_code_names",
    """SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west'
    WHEN 2 THEN 'east' END AS area FROM nation""",
)
def _(spark, sf_dir):
    area = scalars.label_of(F.col("n_regionkey").cast("int"), {0: "south", 1: "west", 2: "east"})
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", area.alias("area"))


@ENTRIES.add("p13_hash_subsample")
def _(spark, sf_dir):
    return subsample(row_panel(spark, sf_dir), ROW_KEY, 0.3, seed=7).select(*ROW_KEY, "qty")


@ENTRIES.add(
    "p13_md5_subsample",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':3'), 1, 12) AS BIGINT) % 100 < 30""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where(hash_number("o_orderkey", 3) % 100 < 30).select("o_orderkey", "o_totalprice")


@ENTRIES.add(
    "p14_expand_stored_list",
    f"""WITH v AS (SELECT {KEY}, [l_quantity, l_discount, l_tax] AS v FROM lineitem)
    SELECT {KEY}, CAST(unnest(range(3)) AS INTEGER) AS position, unnest(v) AS value FROM v""",
)
def _(spark, sf_dir):
    values = F.concat_ws("', '", *[F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_tax")])
    stored = table(spark, sf_dir, "lineitem").withColumn("stored", F.concat(F.lit("['"), values, F.lit("']")))
    return profile.expand_array(stored, "stored", ROW_KEY)


@ENTRIES.add(
    "p16_production_scaling",
    f"""WITH {SUPPLIERS_SQL},
    lim AS (SELECT member, quantile_cont(x1, 0.03) AS lo, quantile_cont(x1, 0.97) AS hi FROM panel GROUP BY 1),
    w AS (SELECT month, sec, member, greatest(least(x1, hi), lo) AS x1 FROM panel JOIN lim USING (member)),
    s AS (SELECT member, median(x1) AS m, stddev_samp(x1) AS d FROM w GROUP BY 1)
    SELECT month, sec, greatest(least((x1 - m) / nullif(d, 0), 3), -3) AS x1 FROM w JOIN s USING (member)""",
    ["x1"],
)
def _(spark, sf_dir):
    out = clean.standardize_by_group(
        supplier_panel(spark, sf_dir), ["x1"], ["member"], "median", 0.03, 0.97, limit=3
    )
    return out.select("month", "sec", "x1")


@ENTRIES.add(
    "w4_winsorize_whole_frame",
    f"""WITH {ROWS_SQL}, lim AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM rows_)
    SELECT {KEY}, greatest(least(price, hi), lo) AS price FROM rows_, lim""",
    ["price"],
)
def _(spark, sf_dir):
    # The whole frame is one group of any size: always by selection.
    out = clean.winsorize(row_panel(spark, sf_dir), ["price"], 0.01, 0.99, hot_rows=0)
    return out.select(*ROW_KEY, "price")


@ENTRIES.add(
    "w5_winsorize_by_month",
    f"""WITH {ROWS_SQL}, lim AS (SELECT month, quantile_cont(price, 0.01) AS lo,
      quantile_cont(price, 0.99) AS hi FROM rows_ GROUP BY 1)
    SELECT {KEY}, greatest(least(price, hi), lo) AS price FROM rows_ JOIN lim USING (month)""",
    ["price"],
)
def _(spark, sf_dir):
    out = clean.winsorize(row_panel(spark, sf_dir), ["price"], 0.01, 0.99, by=["month"])
    return out.select(*ROW_KEY, "price")


@ENTRIES.add(
    "w6_standardize_whole_frame",
    f"""WITH {ROWS_SQL}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS d FROM rows_)
    SELECT {KEY}, (price - m) / d AS price FROM rows_, s""",
    ["price"],
    digits=7,
)
def _(spark, sf_dir):
    return clean.standardize(row_panel(spark, sf_dir), ["price"]).select(*ROW_KEY, "price")


def _scaled_sql(center):
    return f"""WITH {SUPPLIERS_SQL},
    lim AS (SELECT month, quantile_cont(x1, 0.05) AS lo1, quantile_cont(x1, 0.95) AS hi1,
      quantile_cont(x2, 0.05) AS lo2, quantile_cont(x2, 0.95) AS hi2 FROM panel GROUP BY 1),
    w AS (SELECT month, sec, greatest(least(x1, hi1), lo1) AS x1, greatest(least(x2, hi2), lo2) AS x2
      FROM panel JOIN lim USING (month)),
    s AS (SELECT month, {center}(x1) AS m1, stddev_samp(x1) AS d1, {center}(x2) AS m2,
      stddev_samp(x2) AS d2 FROM w GROUP BY 1)
    SELECT month, sec, (x1 - m1) / nullif(d1, 0) AS x1, (x2 - m2) / nullif(d2, 0) AS x2
    FROM w JOIN s USING (month)"""


@ENTRIES.add("w7_standardize_by_month_median", _scaled_sql("median"), ["x1", "x2"])
def _(spark, sf_dir):
    out = clean.standardize_by_group(
        supplier_panel(spark, sf_dir), ["x1", "x2"], ["month"], "median", 0.05, 0.95
    )
    return out.select("month", "sec", "x1", "x2")


@ENTRIES.add("w7_standardize_by_month_mean", _scaled_sql("avg"), ["x1", "x2"])
def _(spark, sf_dir):
    out = clean.standardize_by_group(
        supplier_panel(spark, sf_dir), ["x1", "x2"], ["month"], "mean", 0.05, 0.95
    )
    return out.select("month", "sec", "x1", "x2")


@ENTRIES.add(
    "w12_relative_return",
    f"""WITH {ROWS_SQL} SELECT {KEY}, fm_ret - avg(fm_ret) OVER (PARTITION BY month) AS rel_ret FROM rows_""",
    ["rel_ret"],
)
def _(spark, sf_dir):
    return clean.relative_return(row_panel(spark, sf_dir), "fm_ret", "month", "rel_ret").select(
        *ROW_KEY, "rel_ret"
    )


@ENTRIES.add(
    "f1_parse_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def _(spark, sf_dir):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.parse_date(text, "dd/MM/yyyy").alias("day")
    )


@ENTRIES.add(
    "f2_day_numbers",
    "SELECT o_orderkey, CAST(DATE '1996-01-01' + CAST(o_orderkey % 5000 AS INTEGER) AS DATE) AS day FROM orders",
)
def _(spark, sf_dir):
    number = F.lit(729025) + F.col("o_orderkey") % 5000
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.from_daynum(number).alias("day"))


@ENTRIES.add(
    "f3_month_start",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_start("o_orderdate").alias("month"))


@ENTRIES.add(
    "f4_month_arithmetic",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS later,
    CAST(date_diff('month', DATE '1996-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS months FROM orders""",
)
def _(spark, sf_dir):
    month = dates.month_start("o_orderdate")
    apart = dates.months_apart(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.add_months(month, 3).alias("later"), apart.cast("int").alias("months")
    )


@ENTRIES.add(
    "f5_stamp_month",
    "SELECT s_suppkey, s_acctbal, DATE '2001-11-01' AS stamped FROM supplier",
)
def _(spark, sf_dir):
    today = F.lit("2001-11-17").cast("date")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal", dates.this_month(today).alias("stamped")
    )


@ENTRIES.add(
    "f6_elementwise_math",
    f"""WITH {ROWS_SQL} SELECT {KEY}, ln(1 + abs(fm_ret)) AS a, pow(fm_ret, 2) AS b,
    CAST(sign(fm_ret) AS DOUBLE) AS c, greatest(abs(fm_ret), 0.0000001) AS d, sqrt(qty) AS e FROM rows_""",
    ["a", "b", "c", "d", "e"],
)
def _(spark, sf_dir):
    r = F.col("fm_ret")
    return row_panel(spark, sf_dir).select(
        *ROW_KEY,
        F.log1p(F.abs(r)).alias("a"),
        F.pow(r, F.lit(2.0)).alias("b"),
        F.signum(r).alias("c"),
        F.greatest(F.abs(r), F.lit(scalars.MAPE_FLOOR)).alias("d"),
        F.sqrt("qty").alias("e"),
    )


@ENTRIES.add(
    "f7_argmax_class",
    """SELECT p_partkey, CASE WHEN p_size >= p_retailprice % 50 AND p_size >= p_partkey % 40 THEN 'T1'
    WHEN p_retailprice % 50 >= p_partkey % 40 THEN 'T2' ELSE 'T3' END AS label FROM part""",
)
def _(spark, sf_dir):
    scores = F.array(
        F.col("p_size").cast("double"), F.col("p_retailprice") % 50, (F.col("p_partkey") % 40).cast("double")
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.argmax_label(scores, ["T1", "T2", "T3"]).alias("label")
    )


@ENTRIES.add(
    "f8_parameter_label",
    "SELECT p_partkey, concat('brand=', p_brand, ', size=', CAST(p_size AS VARCHAR)) AS params FROM part",
)
def _(spark, sf_dir):
    params = F.create_map(
        F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")
    )
    return table(spark, sf_dir, "part").select("p_partkey", scalars.params_label(params).alias("params"))

