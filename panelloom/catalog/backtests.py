"""Splits, folds, portfolios and comparisons."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import returns, splits
from ..operators.bins import discretize_by_month
from ..plans.panels import ROW_KEY, row_panel, supplier_panel
from .base import ROW_TIES, ROWS_SQL, SUPPLIERS_SQL, Register, bin_sql, returns_sql, spread_sql

ENTRIES = Register()
BEGIN, END = "1999-01-01", "2000-12-31"
SPREAD_COLUMNS = ["cumulative_return_diff", "annual_return_diff", "std_diff", "IR"]
CUM_COLUMNS = ["ret", "cumulative_asset", "cumulative_return", "annual_return"]
QUINTILES = f"{SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'cls': ('x1', 5)}, 'month', 'sec')}"


def quintiles(spark, sf_dir, factor="x1"):
    out = discretize_by_month(supplier_panel(spark, sf_dir), [factor], 5, "month", ["sec"], suffix="bin")
    return out.withColumnRenamed(f"{factor}_bin", "cls")


def _split_sql(source, extra="FALSE"):
    return f"""split AS (
    SELECT *, 'test' AS split FROM {source} WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}'
    UNION ALL SELECT *, 'train' FROM {source} WHERE month < DATE '{BEGIN}' OR ({extra} AND month > DATE '{END}'))"""


@ENTRIES.add(
    "d1_split_by_date",
    f"WITH {SUPPLIERS_SQL}, {_split_sql('panel', 'TRUE')} SELECT split, month, sec, x1 FROM split",
)
def _(spark, sf_dir):
    train, test = splits.train_test_split_by_date(
        supplier_panel(spark, sf_dir), "month", BEGIN, END, train_from_future=True
    )
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("split", "month", "sec", "x1")


@ENTRIES.add(
    "d1_overlapping_split",
    f"""WITH {SUPPLIERS_SQL} SELECT 'train' AS split, month, sec FROM panel WHERE month BETWEEN DATE '1996-01-01' AND DATE '{END}'
    UNION ALL SELECT 'test', month, sec FROM panel WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}'""",
)
def _(spark, sf_dir):
    tagged = splits.with_split(supplier_panel(spark, sf_dir), "month", BEGIN, END, "1996-01-01", END)
    return tagged.select("split", "month", "sec")


@ENTRIES.add(
    "d2_train_length",
    f"""WITH {SUPPLIERS_SQL} SELECT 'test' AS split, month, sec FROM panel WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}'
    UNION ALL SELECT 'train', month, sec FROM panel WHERE month BETWEEN DATE '1998-12-01' - INTERVAL 24 MONTH AND DATE '1998-12-01'""",
)
def _(spark, sf_dir):
    train, test = splits.train_test_split(supplier_panel(spark, sf_dir), "month", BEGIN, END, 24, "1998-12-01")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("split", "month", "sec")


@ENTRIES.add(
    "d3_split_by_entity",
    f"""WITH {SUPPLIERS_SQL},
    e AS (SELECT DISTINCT member, sec FROM panel),
    h AS (SELECT member, sec, row_number() OVER (PARTITION BY member ORDER BY
      CAST('0x' || substr(md5(CAST(sec AS VARCHAR) || ':0'), 1, 12) AS BIGINT), sec) AS r,
      count(*) OVER (PARTITION BY member) AS n FROM e)
    SELECT month, p.sec, CASE WHEN r <= ceil(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split
    FROM panel p JOIN h USING (member, sec)""",
)
def _(spark, sf_dir):
    out = splits.split_by_entity(supplier_panel(spark, sf_dir), "sec", "member", 0.8)
    return out.select("month", "sec", "split")


FOLDS_SQL = """span AS (SELECT CAST(date_trunc('month', min(month)) AS DATE) AS b,
  CAST(date_trunc('month', max(month)) AS DATE) AS e FROM panel),
len AS (SELECT *, CAST(floor(date_diff('month', b, e) / CAST(4 AS DOUBLE) + 1) AS INTEGER) AS l FROM span),
folds AS (SELECT CAST(i AS INTEGER) AS fold, CAST(b + to_months(CAST(i * l AS INTEGER)) AS DATE) AS val_begin,
  CASE WHEN i = 3 THEN e ELSE CAST(b + to_months(CAST((i + 1) * l - 1 AS INTEGER)) AS DATE) END AS val_end
  FROM len, range(4) t(i))"""


@ENTRIES.add("d4_validation_dates", f"WITH {SUPPLIERS_SQL}, {FOLDS_SQL} SELECT * FROM folds")
def _(spark, sf_dir):
    return splits.fold_table(spark, supplier_panel(spark, sf_dir), "month", 4)


PURGED_SQL = f"""{FOLDS_SQL},
roles AS (SELECT p.*, fold, CASE WHEN month BETWEEN val_begin AND val_end THEN 'val'
  WHEN month BETWEEN val_begin - INTERVAL 3 MONTH AND val_begin - INTERVAL 1 MONTH THEN NULL
  WHEN month BETWEEN val_end + INTERVAL 1 MONTH AND val_end + INTERVAL 4 MONTH THEN NULL ELSE 'train' END AS role
  FROM panel p, folds)"""


@ENTRIES.add(
    "d5_purged_folds",
    f"WITH {SUPPLIERS_SQL}, {PURGED_SQL} SELECT month, sec, fold, role FROM roles WHERE role IS NOT NULL",
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    folds = splits.val_dates(*splits.month_span(panel, "month"), 4)
    out = splits.purged_folds(panel, "month", folds, 3, 1, train_from_future=True)
    return out.select("month", "sec", "fold", "role")


@ENTRIES.add(
    "l1_class_returns",
    f"WITH {QUINTILES}, {returns_sql('binned', '', 'cls', range(5), 'fm_ret')} SELECT * FROM cum",
    CUM_COLUMNS,
)
def _(spark, sf_dir):
    cum = returns.calculate_return(quintiles(spark, sf_dir), "month", "cls", range(5), "fm_ret")
    return cum.withColumnRenamed("fm_ret", "ret")


@ENTRIES.add(
    "l2_cumulative_spread",
    f"""WITH {QUINTILES}, {returns_sql('binned', '', 'cls', range(5), 'fm_ret')}, {spread_sql('', 4, 0)}
    SELECT month, cumulative_return_diff FROM spread""",
    ["cumulative_return_diff"],
)
def _(spark, sf_dir):
    cum = returns.calculate_return(quintiles(spark, sf_dir), "month", "cls", range(5), "fm_ret")
    return returns.calculate_diff_return(cum, "month", "cls", 4, 0)


@ENTRIES.add(
    "l3_information_ratio",
    f"""WITH {QUINTILES}, {returns_sql('binned', '', 'cls', range(5), 'fm_ret')}, {spread_sql('', 4, 0)}
    SELECT * FROM spread""",
    SPREAD_COLUMNS,
)
def _(spark, sf_dir):
    cum = returns.calculate_return(quintiles(spark, sf_dir), "month", "cls", range(5), "fm_ret")
    return returns.calculate_diff_ir(cum, "month", "cls", 4, 0, "fm_ret")


@ENTRIES.add(
    "l4_train_test_backtest",
    f"""WITH {QUINTILES}, {_split_sql('binned')}, {returns_sql('split', '', 'cls', range(5), 'fm_ret', 'split')}
    SELECT * FROM cum""",
    CUM_COLUMNS,
)
def _(spark, sf_dir):
    rows = splits.with_split(quintiles(spark, sf_dir), "month", BEGIN, END)
    out = returns.perform_backtest(rows, "month", "cls", range(5), "fm_ret", 4, 0)
    return out["cum_return"].withColumnRenamed("fm_ret", "ret")


def _row_backtest(spark, sf_dir):
    ranked = discretize_by_month(row_panel(spark, sf_dir), ["qty"], 5, "month", ROW_KEY, suffix="rank")
    rows = splits.with_split(ranked, "month", BEGIN, END)
    return returns.perform_backtest(rows, "month", "qty_rank", range(5), "fm_ret", 4, 0)["diff"]


@ENTRIES.add(
    "l6_single_factor_backtest",
    f"""WITH {ROWS_SQL}, {bin_sql('rows_', 'binned', {'cls': ('qty', 5)}, 'month', ROW_TIES)}, {_split_sql('binned')},
    {returns_sql('split', '', 'cls', range(5), 'fm_ret', 'split')}, {spread_sql('', 4, 0, 'split')}
    SELECT * FROM spread""",
    SPREAD_COLUMNS,
)
def _(spark, sf_dir):
    return _row_backtest(spark, sf_dir)


def _models_sql():
    parts = []
    for f in ("x1", "x2"):
        parts.append(bin_sql("panel", f"{f}_binned", {"cls": (f, 5)}, "month", "sec"))
        parts.append(returns_sql(f"{f}_binned", f, "cls", range(5), "fm_ret"))
        parts.append(spread_sql(f, 4, 0))
    return ",\n".join(parts)


@ENTRIES.add(
    "l7_model_comparison",
    f"""WITH {SUPPLIERS_SQL}, {_models_sql()} SELECT 'x1' AS model, month, cumulative_return_diff FROM x1spread
    UNION ALL SELECT 'x2', month, cumulative_return_diff FROM x2spread""",
    ["cumulative_return_diff"],
)
def _(spark, sf_dir):
    tagged = quintiles(spark, sf_dir, "x1").withColumn("model", F.lit("x1")).unionByName(
        quintiles(spark, sf_dir, "x2").withColumn("model", F.lit("x2"))
    )
    cum = returns.calculate_return(tagged, "month", "cls", range(5), "fm_ret", ["model"])
    return returns.model_comparison(cum, "month", "cls", 4, 0, ["x1", "x2"])


