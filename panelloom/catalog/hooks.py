"""User functions over rows, groups and pairs of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..operators import hooks
from ..plans.panels import row_panel, supplier_panel
from .base import ROWS_SQL, Register, SUPPLIERS_SQL

ENTRIES = Register()


@ENTRIES.add(
    "ud1_element_hook",
    f"""WITH {ROWS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN fm_ret > 0 THEN ln(1 + price) ELSE -ln(1 + price) END AS signed FROM rows_""",
    ["signed"],
)
def _(spark, sf_dir):
    def signed(ret: pd.Series, price: pd.Series) -> np.ndarray:
        return np.where(ret > 0, 1.0, -1.0) * np.log1p(price)

    out = hooks.apply_elements(row_panel(spark, sf_dir), ["fm_ret", "price"], signed, "signed", "double")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "signed")


@ENTRIES.add(
    "ud1_group_apply",
    f"WITH {SUPPLIERS_SQL} SELECT month, corr(x1, x2) AS r, count(*) AS n FROM panel GROUP BY 1",
    ["r"],
)
def _(spark, sf_dir):
    def correlation(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows["x1"].corr(rows["x2"]) if len(rows) > 1 else None
        return pd.DataFrame({"month": rows["month"].iloc[:1], "r": [r], "n": [len(rows)]})

    panel = supplier_panel(spark, sf_dir).select("month", "x1", "x2")
    return hooks.apply_groups(panel, ["month"], correlation, "month date, r double, n long")


@ENTRIES.add(
    "ud1_group_apply_in_parts",
    f"""WITH {ROWS_SQL} SELECT month, CAST(count(*) AS BIGINT) AS n, min(price) AS low, max(price) AS high FROM rows_ GROUP BY 1""",
    ["low", "high"],
)
def _(spark, sf_dir):
    def part(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows["price"]
        return pd.DataFrame({"month": rows["month"].iloc[:1], "n": [len(rows)], "low": [p.min()], "high": [p.max()]})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "month": parts["month"].iloc[:1], "n": [parts["n"].sum()], "low": [parts["low"].min()], "high": [parts["high"].max()],
        })

    rows = row_panel(spark, sf_dir).select("month", "price")
    return hooks.apply_groups(rows, ["month"], part, "month date, n long, low double, high double", merge, limit=200)


@ENTRIES.add(
    "ud1_group_transform",
    f"WITH {SUPPLIERS_SQL} SELECT month, sec, x1 - median(x1) OVER (PARTITION BY month) AS gap FROM panel",
    ["gap"],
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir).select("month", "sec", "x1")
    out = hooks.transform_groups(panel, ["month"], "x1", lambda v: v - v.median(), "gap")
    return out.select("month", "sec", "gap")


@ENTRIES.add(
    "ud1_cogroup_apply",
    f"""WITH {SUPPLIERS_SQL} SELECT month, avg(x1) FILTER (member = 1) - avg(x1) FILTER (member = 0) AS gap FROM panel GROUP BY 1""",
    ["gap"],
)
def _(spark, sf_dir):
    def gap(inside: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([inside, outside])
        value = inside["x1"].mean() - outside["x1"].mean() if len(inside) and len(outside) else None
        return pd.DataFrame({"month": both["month"].iloc[:1], "gap": [value]})

    panel = supplier_panel(spark, sf_dir).select("month", "member", "x1")
    sides = (panel.where(f"member = {m}").drop("member") for m in (1, 0))
    return hooks.apply_cogroups(*sides, ["month"], gap, "month date, gap double")
