"""How a query and its SQL are registered, and the panels in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

# Decimal places to which floating results are rounded on both sides.
DIGITS = 9


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None = None


class Register(dict):
    """Collects entries; floating columns are rounded alike in Spark and in SQL."""

    def add(self, name: str, sql: str | None = None, doubles=(), digits: int = DIGITS):
        def take(fn: Query) -> Query:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = fn(spark, sf_dir)
                # Adding zero turns a rounded -0.0 into 0.0.
                fixed = {c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles}
                return df.withColumns(fixed) if fixed else df

            text = sql
            if text is not None and doubles:
                swaps = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles)
                text = f"SELECT * REPLACE ({swaps}) FROM ({text}) AS q"
            self[name] = Entry(query, text)
            return fn

        return take


ROWS_SQL = """rows_ AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
         l_quantity AS qty, l_extendedprice AS price, l_discount - l_tax AS fm_ret
  FROM lineitem)"""

SUPPLIERS_SQL = """base_ AS (
  SELECT l_suppkey AS sec, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         sum(l_quantity) / count(*) AS x1,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
           / (count(*) * CAST(100000 AS DOUBLE)) AS x2,
         CAST(sum(CAST(round((l_discount - l_tax) * 100) AS BIGINT)) AS DOUBLE)
           / (count(*) * CAST(100 AS DOUBLE)) AS fm_ret,
         count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT b.*, lead(fm_ret, 1) OVER own + lead(fm_ret, 2) OVER own + lead(fm_ret, 3) OVER own
           AS fq_ret,
         CAST(s_nationkey AS INTEGER) AS sector, CAST(s_acctbal > 0 AS INTEGER) AS member
  FROM base_ b JOIN supplier ON s_suppkey = sec
  WINDOW own AS (PARTITION BY sec ORDER BY month))"""

MARKET_SQL = """market AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
           / (count(*) * CAST(10000000 AS DOUBLE)) AS level,
         max(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(10000000 AS DOUBLE) AS high,
         min(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(10000000 AS DOUBLE) AS low
  FROM orders GROUP BY 1)"""

ROW_TIES = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
)


def bin_sql(source: str, target: str, bins: dict[str, tuple[str, int]], by: str, ties: str) -> str:
    """CTEs that add quantile classes ``{output: (variable, n)}`` to ``source``."""
    ranks = ", ".join(
        f"CASE WHEN {v} IS NOT NULL THEN row_number() OVER (PARTITION BY {by} "
        f"ORDER BY {v} NULLS LAST, {ties}) END AS r_{out}, "
        f"count({v}) OVER (PARTITION BY {by}) AS n_{out}"
        for out, (v, _) in bins.items()
    )
    classes = ", ".join(
        f"CAST(CASE WHEN r_{out} IS NOT NULL THEN greatest("
        f"((r_{out} - 1) * {n} + n_{out} - 2) // nullif(n_{out} - 1, 0), 1) - 1 END AS INTEGER) "
        f"AS {out}"
        for out, (_, n) in bins.items()
    )
    drop = ", ".join(f"r_{out}, n_{out}" for out in bins)
    return (
        f"{target}_ranked AS (SELECT *, {ranks} FROM {source}),\n"
        f"{target} AS (SELECT * EXCLUDE ({drop}), {classes} FROM {target}_ranked)"
    )


def returns_sql(source: str, prefix: str, cls: str, classes, ret: str, keys: str = "") -> str:
    """CTEs for compounded class returns of ``source``; the last is ``{prefix}cum``."""
    k = f"{keys}, " if keys else ""
    on = "".join(f" AND m.{c.strip()} = g.{c.strip()}" for c in keys.split(",")) if keys else ""
    g = "".join(f"g.{c.strip()}, " for c in keys.split(",")) if keys else ""
    values = ", ".join(f"({c})" for c in classes)
    return f"""{prefix}mean AS (
  SELECT {k}month, {cls} AS cls, avg({ret}) AS ret FROM {source}
  WHERE {cls} IS NOT NULL GROUP BY ALL),
{prefix}grid AS (
  SELECT * FROM (SELECT DISTINCT {k}month FROM {prefix}mean), (VALUES {values}) AS c(cls)),
{prefix}dense AS (
  SELECT {g}g.month, g.cls, coalesce(m.ret, 0) AS ret
  FROM {prefix}grid g LEFT JOIN {prefix}mean m ON m.month = g.month AND m.cls = g.cls{on}),
{prefix}seeded AS (
  SELECT * FROM {prefix}dense UNION ALL BY NAME
  SELECT {k}CAST(min(month) - INTERVAL 1 MONTH AS DATE) AS month, cls, 0.0 AS ret
  FROM {prefix}dense GROUP BY {k}cls),
{prefix}asset AS (
  SELECT *, product(1 + ret) OVER w AS cumulative_asset, count(*) OVER w - 1 AS t
  FROM {prefix}seeded
  WINDOW w AS (PARTITION BY {k}cls ORDER BY month ROWS UNBOUNDED PRECEDING)),
{prefix}cum AS (
  SELECT {k}month, cls, ret, cumulative_asset, cumulative_asset - 1 AS cumulative_return,
         CASE WHEN t > 0 THEN pow(cumulative_asset, CAST(12 AS DOUBLE) / t) - 1 ELSE 0 END
           AS annual_return
  FROM {prefix}asset)"""


def spread_sql(prefix: str, top, bottom, keys: str = "") -> str:
    """CTEs for the spread of ``{prefix}cum``; the last is ``{prefix}spread``."""
    k = f"{keys}, " if keys else ""

    def gap(c):
        return (
            f"max(CASE WHEN cls = {top} THEN {c} END) - max(CASE WHEN cls = {bottom} THEN {c} END)"
        )

    part = f"PARTITION BY {keys} " if keys else ""
    return f"""{prefix}gap AS (
  SELECT {k}month, {gap('cumulative_return')} AS cumulative_return_diff,
         {gap('annual_return')} AS annual_return_diff, {gap('ret')} AS ret_diff
  FROM {prefix}cum WHERE cls IN ({top}, {bottom}) GROUP BY {k}month),
{prefix}risk AS (
  SELECT *, stddev_samp(ret_diff) OVER ({part}ORDER BY month ROWS UNBOUNDED PRECEDING)
           * sqrt(12) AS std_diff FROM {prefix}gap),
{prefix}spread AS (
  SELECT {k}month, cumulative_return_diff, annual_return_diff, std_diff,
         annual_return_diff / nullif(std_diff, 0) AS "IR" FROM {prefix}risk)"""


def ridge_sql(source: str, target: str, y: str, alpha, group: str = "", intercept: bool = True,
              x=("x1", "x2")) -> str:
    """CTEs for a two-feature ridge per ``group``; ``target`` has intercept, b1 and b2."""
    a, b = x
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    if intercept:
        s11, s22, s12 = "s11 - s1 * s1 / n", "s22 - s2 * s2 / n", "s12 - s1 * s2 / n"
        t1, t2 = "t1 - s1 * sy / n", "t2 - s2 * sy / n"
        c = "sy / n - b1 * s1 / n - b2 * s2 / n"
    else:
        s11, s22, s12, t1, t2, c = "s11", "s22", "s12", "t1", "t2", "0"
    return f"""{target}_sums AS (
  SELECT {g}CAST(count(*) AS DOUBLE) AS n, sum({y}) AS sy, sum({a}) AS s1, sum({b}) AS s2,
    sum({a} * {a}) AS s11, sum({b} * {b}) AS s22, sum({a} * {b}) AS s12, sum({a} * {y}) AS t1,
    sum({b} * {y}) AS t2
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {y} IS NOT NULL{by}),
{target}_mid AS (SELECT *, {s11} + {alpha} AS m11, {s22} + {alpha} AS m22, {s12} AS m12, {t1} AS r1, {t2} AS r2
  FROM {target}_sums),
{target}_coef AS (SELECT *, (r1 * m22 - r2 * m12) / (m11 * m22 - m12 * m12) AS b1,
  (r2 * m11 - r1 * m12) / (m11 * m22 - m12 * m12) AS b2 FROM {target}_mid),
{target} AS (SELECT {g}n, {c} AS intercept, b1, b2 FROM {target}_coef)"""


def trees_sql(
    source: str, target: str, y: str, rounds: int, depth: int, bins: int, eta: float, lam: float, mcw: float,
    gamma: float = 0.0, start: float = 0.0, x=("x1", "x2"), train: str = "TRUE", n_classes: int = 0,
) -> str:
    """CTEs for histogram-boosted trees fitted on the rows of ``source`` where ``train`` holds and
    ``y`` is known. ``target`` is ``source`` with ``score0..`` (one per class, or one), ``target_nodes``
    has the nodes of all trees. Squared loss, or softmax with ``n_classes``."""
    t, k_all = target, max(n_classes, 1)
    cuts = " UNION ALL ".join(
        f"""SELECT {f} AS f, c, row_number() OVER (ORDER BY c) - 1 AS j FROM (SELECT DISTINCT
      unnest(quantile_cont({c}, [{', '.join(repr(i / bins) for i in range(1, bins))}])) AS c FROM {t}_id WHERE fit)"""
        for f, c in enumerate(x)
    )
    cells = " UNION ALL ".join(
        f"""SELECT id, {f} AS f, CASE WHEN {c} IS NULL THEN -1 ELSE (SELECT count(*) FROM {t}_cut q
      WHERE q.f = {f} AND q.c < {c}) END AS b FROM {t}_id""" for f, c in enumerate(x)
    )
    scores = ", ".join(f"CAST({start} AS DOUBLE) AS score{k}" for k in range(k_all))
    parts = [
        f"{t}_id AS MATERIALIZED (SELECT *, row_number() OVER () AS id, ({train}) AND {y} IS NOT NULL AS fit FROM {source})",
        f"{t}_cut AS MATERIALIZED ({cuts})",
        f"{t}_bin AS MATERIALIZED ({cells})",
        f"{t}_place AS MATERIALIZED (SELECT f, j, c FROM {t}_cut UNION ALL "
        f"SELECT f, count(*), CAST('inf' AS DOUBLE) FROM {t}_cut GROUP BY 1)",
        f"{t}_s0 AS MATERIALIZED (SELECT id, fit, {y} AS y, {scores} FROM {t}_id)",
    ]
    nodes = []
    for r in range(rounds):
        for k in range(k_all):
            if n_classes:
                total = " + ".join(f"exp(score{i})" for i in range(k_all))
                p = f"exp(score{k}) / ({total})"
                g, h = f"{p} - CAST(y = {k} AS INTEGER)", f"greatest(2 * {p} * (1 - {p}), 1e-16)"
            else:
                g, h = "score0 - y", "1.0"
            at = f"{t}_r{r}k{k}"
            parts.append(
                f"{at}d0 AS MATERIALIZED (SELECT id, fit, {g} AS g, CAST({h} AS DOUBLE) AS h, 0 AS node FROM {t}_s{r})"
            )
            for d in range(depth):
                now = f"{at}d{d}"
                parts += [
                    f"""{now}h AS MATERIALIZED (SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {now} JOIN {t}_bin USING (id)
      WHERE fit AND node >= {2**d - 1} GROUP BY ALL)""",
                    f"""{now}c AS (SELECT h.node, h.f, p.j, p.c, side, sum(h.g) AS ga, sum(h.h) AS ha, sum(h.n) AS na,
        sum(h.g) FILTER (b >= 0 AND b <= j OR b < 0 AND side = 1) AS gl, sum(h.h) FILTER (b >= 0 AND b <= j OR b < 0 AND side = 1) AS hl,
        sum(h.n) FILTER (b >= 0 AND b <= j OR b < 0 AND side = 1) AS nl
      FROM {now}h h JOIN {t}_place p ON p.f = h.f, range(2) AS o(side) WHERE NOT (isinf(p.c) AND side = 1) GROUP BY ALL)""",
                    f"""{now}g AS MATERIALIZED (SELECT *, gl * gl / (hl + {lam}) + (ga - gl) * (ga - gl) / (ha - hl + {lam}) - ga * ga / (ha + {lam}) AS gain
      FROM {now}c WHERE nl > 0 AND nl < na AND hl >= {mcw} AND ha - hl >= {mcw})""",
                    f"""{now}b AS MATERIALIZED (SELECT * FROM (SELECT *, max(gain) OVER (PARTITION BY node) AS top FROM {now}g)
      WHERE gain >= top - 1e-9 * abs(top) AND top > 1e-6 AND top >= {gamma}
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY f, side, j) = 1)""",
                    f"""{at}d{d + 1} AS MATERIALIZED (SELECT s.id, fit, g, h, CASE WHEN q.node IS NULL THEN s.node
        WHEN CASE WHEN b < 0 THEN side = 1 ELSE b <= j END THEN 2 * s.node + 1 ELSE 2 * s.node + 2 END AS node
      FROM {now} s LEFT JOIN {now}b q ON q.node = s.node LEFT JOIN {t}_bin x ON x.id = s.id AND x.f = q.f)""",
                ]
                nodes.append(
                    f"SELECT {r} AS round, {k} AS output, node, f, c AS cut, side = 1 AS missing_left, gain, CAST(na AS DOUBLE) AS cover,"
                    f" CAST(NULL AS DOUBLE) AS value FROM {now}b"
                )
            parts.append(
                f"""{at}l AS MATERIALIZED (SELECT node, -{eta} * sum(g) FILTER (fit) / (sum(h) FILTER (fit) + {lam}) AS value, count(*) FILTER (fit) AS n
      FROM {at}d{depth} GROUP BY 1)"""
            )
            nodes.append(
                f"SELECT {r}, {k}, node, CAST(NULL AS INTEGER), NULL, NULL, NULL, CAST(n AS DOUBLE), value FROM {at}l WHERE n > 0"
            )
        joins = " ".join(
            f"JOIN {t}_r{r}k{k}d{depth} d{k} ON d{k}.id = s.id JOIN {t}_r{r}k{k}l l{k} ON l{k}.node = d{k}.node" for k in range(k_all)
        )
        added = ", ".join(f"s.score{k} + coalesce(l{k}.value, 0) AS score{k}" for k in range(k_all))
        parts.append(f"{t}_s{r + 1} AS MATERIALIZED (SELECT s.id, s.fit, s.y, {added} FROM {t}_s{r} s {joins})")
    named = ", ".join(f"'{c}'" for c in x)
    parts.append(
        f"{t}_nodes AS (SELECT round, output, node, [{named}][f + 1] AS factor, cut, missing_left, value, gain, cover "
        f"FROM ({' UNION ALL '.join(nodes)}))"
    )
    last = ", ".join(f"score{k}" for k in range(k_all))
    parts.append(f"{t} AS (SELECT i.* EXCLUDE (fit), {last} FROM {t}_id i JOIN {t}_s{rounds} USING (id))")
    return ",\n".join(parts)


def newton_sql(source: str, target: str, hit: str, steps: int, c: float | None, x=("x1", "x2")) -> str:
    """CTEs for ``steps`` Newton steps of a two-factor logistic regression of the condition ``hit``
    from zero; ``target`` has w0, w1 and w2."""
    a, b = x
    pen = 0.0 if c is None else 1.0 / c
    parts = [f"{target}_w0 AS (SELECT CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2)"]
    for i in range(steps):
        parts.append(f"""{target}_p{i} AS (SELECT {a} AS x, {b} AS z, CAST({hit} AS INTEGER) AS y, 1 / (1 + exp(-(w0 + w1 * {a} + w2 * {b}))) AS p
  FROM {source}, {target}_w{i} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
{target}_m{i} AS (SELECT sum(p - y) AS g0, sum((p - y) * x) + {pen} * any_value(w1) AS g1, sum((p - y) * z) + {pen} * any_value(w2) AS g2,
    sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p) * z) AS c, sum(p * (1 - p) * x * x) + {pen} AS d,
    sum(p * (1 - p) * x * z) AS e, sum(p * (1 - p) * z * z) + {pen} AS f, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2
  FROM {target}_p{i}, {target}_w{i}),
{target}_d{i} AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM {target}_m{i}),
{target}_w{i + 1} AS (SELECT
    w0 - ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / det AS w0,
    w1 - ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / det AS w1,
    w2 - ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det AS w2 FROM {target}_d{i})""")
    parts.append(f"{target} AS (SELECT * FROM {target}_w{steps})")
    return ",\n".join(parts)


def walk_sql(nodes: str, points: str, target: str, x: tuple[str, ...], depth: int, start: float = 0.0) -> str:
    """CTEs that score ``points`` (id and factors) with the trees of a node table: (id, output, score)."""
    value = "CASE n.factor " + " ".join(f"WHEN '{c}' THEN p.{c}" for c in x) + " END"
    parts = [f"{target}_0 AS (SELECT p.*, t.round, t.output, 0 AS node FROM {points} p, (SELECT DISTINCT round, output FROM {nodes}) t)"]
    names = ", ".join(f"p.{c}" for c in x)
    for d in range(depth):
        parts.append(f"""{target}_{d + 1} AS (SELECT p.id, {names}, p.round, p.output, CASE WHEN n.factor IS NULL THEN p.node
      WHEN {value} <= n.cut OR {value} IS NULL AND n.missing_left THEN 2 * p.node + 1 ELSE 2 * p.node + 2 END AS node
  FROM {target}_{d} p JOIN {nodes} n ON n.round = p.round AND n.output = p.output AND n.node = p.node)""")
    parts.append(f"""{target} AS (SELECT p.id, p.output, {start} + sum(n.value) AS score FROM {target}_{depth} p
  JOIN {nodes} n ON n.round = p.round AND n.output = p.output AND n.node = p.node GROUP BY ALL)""")
    return ",\n".join(parts)
