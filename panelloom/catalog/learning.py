"""Models, walk-forward prediction and scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scalars import LOSSES, gradients
from ..operators import learners, linear, metrics
from ..operators.bins import discretize_by_month, rank_predictions
from ..operators.boosting import fit_boosted
from ..operators.neighbors import knn_predict
from ..operators.returns import calculate_diff_ir, calculate_return
from ..operators.splits import in_periods, train_test_split_by_date
from ..plans.panels import supplier_panel
from ..session import staging_path
from .base import (
    Register, SUPPLIERS_SQL, bin_sql, newton_sql, returns_sql, ridge_sql, spread_sql, trees_sql,
)
from .joins import PERIODS, _periods_sql

ENTRIES = Register()
BEGIN, END = "1999-01-01", "2000-12-31"
X = ["x1", "x2"]
KEY = ["month", "sec"]
TRAIN_SQL = f"train AS (SELECT * FROM panel WHERE month < DATE '{BEGIN}')"
TEST_SQL = f"test AS (SELECT * FROM panel WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}')"
BOTH_SQL = f"""{TRAIN_SQL}, {TEST_SQL},
both_ AS (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'test' FROM test)"""
PRED_SQL = "intercept + b1 * x1 + b2 * x2"


def sides(spark, sf_dir, label="fq_ret"):
    panel = supplier_panel(spark, sf_dir).where(F.col(label).isNotNull())
    return train_test_split_by_date(panel, "month", BEGIN, END)


def classed(spark, sf_dir, n=3):
    """Panel with its forward return's class as a numeric label."""
    panel = supplier_panel(spark, sf_dir).where("fq_ret is not null")
    out = discretize_by_month(panel, ["fq_ret"], n, "month", ["sec"], suffix="cls")
    return out.withColumn("fq_ret_cls", F.col("fq_ret_cls").cast("double"))


def class_sides(spark, sf_dir, n=3):
    return train_test_split_by_date(classed(spark, sf_dir, n), "month", BEGIN, END)


def both(train, test):
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@ENTRIES.add(
    "m1_ridge_coefficients",
    f"WITH {SUPPLIERS_SQL}, {ridge_sql('panel', 'fit', 'fq_ret', 10.0)} SELECT n, intercept, b1 AS coef_0, b2 AS coef_1 FROM fit",
    ["n", "intercept", "coef_0", "coef_1"],
)
def _(spark, sf_dir):
    return linear.fit_ridge(supplier_panel(spark, sf_dir), X, "fq_ret", 10.0)


@ENTRIES.add(
    "m1_ridge_by_sector",
    f"""WITH {SUPPLIERS_SQL}, {ridge_sql('panel', 'fit', 'fq_ret', 1.0, 'sector')}
    SELECT sector, n, intercept, b1 AS coef_0, b2 AS coef_1 FROM fit""",
    ["n", "intercept", "coef_0", "coef_1"],
)
def _(spark, sf_dir):
    return linear.fit_ridge(supplier_panel(spark, sf_dir), X, "fq_ret", 1.0, by=["sector"])


@ENTRIES.add(
    "m2_single_factor_regression_portfolios",
    f"""WITH {SUPPLIERS_SQL}, fit AS (SELECT sum(x1 * fq_ret) / sum(x1 * x1) AS b FROM panel
      WHERE month < DATE '{BEGIN}' AND fq_ret IS NOT NULL),
    p AS (SELECT panel.*, b * x1 AS pred FROM panel, fit WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}'),
    {bin_sql('p', 'r', {'cls': ('pred', 5)}, 'month', 'sec')}, {returns_sql('r', '', 'cls', range(5), 'fm_ret')},
    {spread_sql('', 4, 0)} SELECT * FROM spread""",
    ["cumulative_return_diff", "annual_return_diff", "std_diff", "IR"],
)
def _(spark, sf_dir):
    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    coefs = linear.fit_ridge(train, ["x1"], "fq_ret", fit_intercept=False)
    ranked = rank_predictions(linear.predict_linear(test, coefs, ["x1"]), 5, "month", ["sec"])
    cum = calculate_return(ranked, "month", "pred_rank", range(5), "fm_ret")
    return calculate_diff_ir(cum, "month", "pred_rank", 4, 0, "fm_ret")


CLASSED_PANEL_SQL = f"""{SUPPLIERS_SQL.replace("panel AS", "panel0 AS")},
labelled AS (SELECT * FROM panel0 WHERE fq_ret IS NOT NULL), {bin_sql("labelled", "panel", {"cls": ("fq_ret", 3)}, "month", "sec")},
{TRAIN_SQL}, {TEST_SQL}"""
STEPS = 4  # Newton steps from zero, on both sides of the comparison


def rest_sql(c, source="train", suffix=""):
    """The three models of a one-vs-rest scheme."""
    return ", ".join(newton_sql(source, f"w{k}{suffix}", f"cls = {k}", STEPS, c) for k in range(3))


MARGINS_SQL = ", ".join(f"w{k}.w0 + w{k}.w1 * x1 + w{k}.w2 * x2 AS m{k}" for k in range(3))
WINNER_SQL = "CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0.0 WHEN m1 >= m2 THEN 1.0 ELSE 2.0 END"


@ENTRIES.add("m3_logistic_multinomial")
def _(spark, sf_dir):
    train, test = class_sides(spark, sf_dir)
    _, pred = learners.predict(learners.logistic(X, "fq_ret_cls", 3), train, test, KEY)
    return pred


@ENTRIES.add(
    "m3_logistic_one_vs_rest",
    f"""WITH {CLASSED_PANEL_SQL}, {rest_sql(None)}, m AS (SELECT month, sec, {MARGINS_SQL} FROM test, w0, w1, w2)
    SELECT month, sec, {WINNER_SQL} AS pred FROM m""",
    ["pred"],
)
def _(spark, sf_dir):
    train, test = class_sides(spark, sf_dir)
    model = learners.logistic_one_vs_rest(X, "fq_ret_cls", 3, max_iter=STEPS)
    return learners.predict(model, train, test, KEY)[1]


@ENTRIES.add(
    "m3_logistic_coefficients",
    f"""WITH {CLASSED_PANEL_SQL}, {rest_sql(0.05)}, w AS ({' UNION ALL '.join(f'SELECT {k} AS class, * FROM w{k}' for k in range(3))})
    SELECT class, 'intercept' AS term, w0 AS value FROM w UNION ALL SELECT class, 'x1', w1 FROM w UNION ALL SELECT class, 'x2', w2 FROM w""",
    ["value"], digits=7,
)
def _(spark, sf_dir):
    train, _ = class_sides(spark, sf_dir)
    return learners.logistic_one_vs_rest(X, "fq_ret_cls", 3, c=0.05, max_iter=STEPS).fit(train).coefficients(spark)


# Settings of the tree queries, by the learners' names and for ``trees_sql``.
TREES = {"n_estimators": 3, "eta": 0.3, "min_child_weight": 20.0, "max_bins": 16}
TREES_SQL = {"rounds": 3, "bins": 16, "eta": 0.3, "lam": 1.0, "mcw": 20.0}
GAPS_SQL = """gaps AS (SELECT * REPLACE (CASE WHEN sec % 7 = 0 THEN NULL ELSE x1 END AS x1,
  CASE WHEN sec % 5 = 1 THEN NULL ELSE x2 END AS x2) FROM panel)"""


def with_gaps(panel):
    """The panel with some factors missing."""
    return panel.withColumns({
        "x1": F.when(F.col("sec") % 7 != 0, F.col("x1")), "x2": F.when(F.col("sec") % 5 != 1, F.col("x2")),
    })


@ENTRIES.add(
    "m4_boosted_trees_regression",
    f"""WITH {SUPPLIERS_SQL}, {GAPS_SQL}, {trees_sql('gaps', 'fit', 'fq_ret', depth=3, train=f"month < DATE '{BEGIN}'", **TREES_SQL)}
    SELECT month, sec, score0 AS pred FROM fit WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}'""",
    ["pred"],
)
def _(spark, sf_dir):
    panel = with_gaps(supplier_panel(spark, sf_dir))
    train, test = train_test_split_by_date(panel, "month", BEGIN, END)
    model = learners.boosted_trees(X, "fq_ret", key=KEY, max_depth=3, **TREES)
    return learners.predict(model, train, test, KEY)[1]


@ENTRIES.add(
    "m4_first_tree_nodes",
    f"""WITH {SUPPLIERS_SQL}, {GAPS_SQL}, {trees_sql('gaps', 'fit', 'fq_ret', depth=2, **{**TREES_SQL, 'rounds': 1})}
    SELECT * FROM fit_nodes""",
    ["cut", "value", "gain", "cover"], digits=7,
)
def _(spark, sf_dir):
    model = learners.boosted_trees(X, "fq_ret", key=KEY, max_depth=2, **{**TREES, "n_estimators": 1})
    return model.fit(with_gaps(supplier_panel(spark, sf_dir))).node_table(spark)


@ENTRIES.add(
    "m4_boosted_trees_classification",
    f"""WITH {CLASSED_PANEL_SQL}, both_ AS (SELECT *, TRUE AS learn FROM train UNION ALL SELECT *, FALSE FROM test),
    {trees_sql('both_', 'fit', 'cls', depth=2, train='learn', n_classes=3, **{**TREES_SQL, 'rounds': 2, 'mcw': 5.0})},
    m AS (SELECT month, sec, score0 AS m0, score1 AS m1, score2 AS m2 FROM fit WHERE NOT learn)
    SELECT month, sec, {WINNER_SQL} AS pred FROM m""",
    ["pred"],
)
def _(spark, sf_dir):
    train, test = class_sides(spark, sf_dir)
    settings = {**TREES, "n_estimators": 2, "min_child_weight": 5.0}
    model = learners.boosted_classifier(X, "fq_ret_cls", 3, key=KEY, max_depth=2, **settings)
    return learners.predict(model, train, test, KEY)[1]


KNN_SQL = f"""{TRAIN_SQL.replace('WHERE', 'WHERE fq_ret IS NOT NULL AND')}, {TEST_SQL},
near AS (SELECT q.month, q.sec, t.fq_ret, t.cls,
    row_number() OVER (PARTITION BY q.month, q.sec ORDER BY sqrt(pow(t.x1 - q.x1, 2) + pow(t.x2 - q.x2, 2)),
      t.month, t.sec) AS r FROM test q, train t QUALIFY r <= 100)"""


@ENTRIES.add(
    "m5_nearest_neighbour_regression",
    f"""WITH {SUPPLIERS_SQL.replace("panel AS", "panel0 AS")}, panel AS (SELECT *, 0 AS cls FROM panel0), {KNN_SQL}
    SELECT month, sec, avg(fq_ret) AS pred FROM near GROUP BY ALL""",
    ["pred"],
)
def _(spark, sf_dir):
    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    return knn_predict(train.where("fq_ret is not null"), test, X, "fq_ret", 100, KEY, KEY)


@ENTRIES.add(
    "m5_nearest_neighbour_classification",
    f"""WITH {SUPPLIERS_SQL.replace("panel AS", "panel0 AS")},
    {bin_sql("panel0", "panel", {"cls": ("fq_ret", 3)}, "month", "sec")}, {KNN_SQL},
    v AS (SELECT month, sec, cls, count(*) AS n FROM near GROUP BY ALL)
    SELECT month, sec, cls AS pred FROM v QUALIFY row_number() OVER (PARTITION BY month, sec ORDER BY n DESC, cls) = 1""",
)
def _(spark, sf_dir):
    panel = discretize_by_month(supplier_panel(spark, sf_dir), ["fq_ret"], 3, "month", ["sec"], suffix="cls")
    train, test = train_test_split_by_date(panel, "month", BEGIN, END)
    return knn_predict(train.where("fq_ret is not null"), test, X, "fq_ret_cls", 100, KEY, KEY, "cla")


@ENTRIES.add(
    "m5_nearest_neighbours_of_three_factors",
    f"""WITH {SUPPLIERS_SQL}, {TRAIN_SQL.replace('WHERE', 'WHERE fq_ret IS NOT NULL AND')}, {TEST_SQL},
    near AS (SELECT q.month, q.sec, t.fq_ret FROM test q, train t QUALIFY row_number() OVER (PARTITION BY q.month, q.sec
      ORDER BY sqrt((t.x1 - q.x1) * (t.x1 - q.x1) + (t.x2 - q.x2) * (t.x2 - q.x2) + (t.n_rows - q.n_rows) * (t.n_rows - q.n_rows)),
      t.month, t.sec) <= 25)
    SELECT month, sec, avg(fq_ret) AS pred FROM near GROUP BY ALL""",
    ["pred"],
)
def _(spark, sf_dir):
    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    return knn_predict(train.where("fq_ret is not null"), test, [*X, "n_rows"], "fq_ret", 25, KEY, KEY)


@ENTRIES.add("m6_polynomial_support_vectors")
def _(spark, sf_dir):
    train, test = class_sides(spark, sf_dir)
    model = learners.polynomial_svc(X, "fq_ret_cls", 3, 3, c=0.01, gamma=0.002)
    return learners.predict(model, train, test, KEY)[1]


@ENTRIES.add("m7_net_ensemble")
def _(spark, sf_dir):
    train, test = class_sides(spark, sf_dir)
    fitted = learners.NetEnsemble(X, "fq_ret_cls", [2, 8, 3], n_nets=2, max_iter=20).fit(train)
    return fitted.transform(test).select(*KEY, "pred")


@ENTRIES.add(
    "m8_linear_rank",
    f"""WITH {SUPPLIERS_SQL}, {TRAIN_SQL}, {TEST_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 0.1)},
    p AS (SELECT test.*, {PRED_SQL} AS pred FROM test, fit), {bin_sql('p', 'r', {'cls': ('pred', 3)}, 'month', 'sec')}
    SELECT month, sec, ['T3', 'T2', 'T1'][cls + 1] AS pred_rank FROM r""",
)
def _(spark, sf_dir):
    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    scored = linear.predict_linear(test, linear.fit_ridge(train, X, "fq_ret", 0.1), X)
    return rank_predictions(scored, 3, "month", ["sec"], ["T3", "T2", "T1"]).select(*KEY, "pred_rank")


@ENTRIES.add(
    "m11_residual_edge_blend",
    f"""WITH {SUPPLIERS_SQL}, {BOTH_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 0.1)},
    p AS (SELECT both_.*, {PRED_SQL} AS pred, x2 / 1000 AS edge, fq_ret + x2 / 1000 AS total FROM both_, fit),
    ptrain AS (SELECT * FROM p WHERE split = 'train'),
    {ridge_sql('ptrain', 'w', 'total', 0.0, intercept=False, x=('pred', 'edge'))}
    SELECT split, month, sec, b1 * pred + b2 * edge AS pred_return FROM p, w""",
    ["pred_return"],
)
def _(spark, sf_dir):
    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    coefs = linear.fit_ridge(train, X, "fq_ret", 0.1)
    pred = linear.predict_linear(both(train, test), coefs, X).withColumn("edge", F.col("x2") / 1000)
    weights = linear.fit_blend(pred.where("split = 'train'"), "pred", "edge", "fq_ret")
    return linear.blend(pred, weights, "pred", "edge").select("split", *KEY, "pred_return")


HC3_SQL = """ok AS (SELECT month, x1 AS x, fq_ret AS y FROM panel WHERE fq_ret IS NOT NULL),
s AS (SELECT month, count(*) AS n, avg(x) AS xm, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b,
  regr_intercept(y, x) AS a FROM ok GROUP BY 1),
e AS (SELECT ok.month, n, xm, sxx, a, b, x - xm AS d,
  (y - a - b * x) / nullif(1 - (1.0 / n + (x - xm) * (x - xm) / sxx), 0) AS q FROM ok JOIN s USING (month)),
hc3 AS (SELECT month, any_value(n) AS n, any_value(b) AS slope, any_value(a) AS intercept,
  sqrt(sum(d * d * q * q)) / any_value(sxx) AS slope_se,
  sqrt(sum(pow(1.0 / n - xm * d / sxx, 2) * q * q)) AS intercept_se FROM e GROUP BY 1)"""


@ENTRIES.add(
    "m12_monthly_regression_hc3",
    f"WITH {SUPPLIERS_SQL}, {HC3_SQL} SELECT * FROM hc3",
    ["slope", "intercept", "slope_se", "intercept_se"],
)
def _(spark, sf_dir):
    return linear.panel_regression(supplier_panel(spark, sf_dir), "month", "x1", "fq_ret")


@ENTRIES.add(
    "m12_slopes_by_period",
    f"""WITH {SUPPLIERS_SQL}, {HC3_SQL}, p AS (FROM (VALUES {_periods_sql()}) t(period, b, e))
    SELECT period, avg(slope) AS mean, median(slope) AS median, count(slope) AS n FROM hc3 JOIN p ON month BETWEEN p.b AND p.e GROUP BY 1""",
    ["mean", "median"],
)
def _(spark, sf_dir):
    monthly = linear.panel_regression(supplier_panel(spark, sf_dir), "month", "x1", "fq_ret")
    return linear.panel_regression_by_period(in_periods(monthly, "month", PERIODS), "period")


@ENTRIES.add(
    "m13_fit_and_predict",
    f"""WITH {SUPPLIERS_SQL}, {BOTH_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 5.0)}
    SELECT split, month, sec, x1, x2, fm_ret, {PRED_SQL} AS pred FROM both_, fit WHERE fq_ret IS NOT NULL""",
    ["pred"], digits=7,
)
def _(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    size = train.agg(F.count("fq_ret"), F.stddev_pop("fq_ret")).first()
    model = learners.linear_regression(X, "fq_ret", alpha=5.0, n_rows=size[0], label_std=size[1])
    return both(*learners.predict(model, train, test, [*KEY, *X, "fm_ret"]))


WALK_SQL = f"""m AS (SELECT DISTINCT month FROM panel WHERE month BETWEEN DATE '{BEGIN}' AND DATE '{END}'),
grown AS (SELECT m.month AS at_month, p.* FROM m JOIN panel p ON p.month < m.month),
{ridge_sql('grown', 'fit', 'fq_ret', 1.0, 'at_month')}"""


@ENTRIES.add(
    "m14_walk_forward",
    f"""WITH {SUPPLIERS_SQL}, {WALK_SQL} SELECT month, sec, {PRED_SQL} AS pred FROM panel JOIN fit ON fit.at_month = month""",
    ["pred"],
)
def _(spark, sf_dir):
    out = linear.walk_forward(supplier_panel(spark, sf_dir), "month", X, "fq_ret", BEGIN, END, 1.0)
    return out.select(*KEY, "pred")


def _tree_walk_sql():
    """A fit per test month, on all rows before it."""
    months = [f"{y}-{m:02d}-01" for y in (1999,) for m in (1, 5, 9)]
    fits = ", ".join(
        trees_sql("walked", f"t{i}", "fq_ret", depth=2, train=f"month < DATE '{m}'", **{**TREES_SQL, "rounds": 2})
        .replace(f"FROM t{i}_id WHERE fit)", f"FROM walked WHERE fq_ret IS NOT NULL AND month < DATE '{BEGIN}')")
        for i, m in enumerate(months)
    )
    return f"walked AS (SELECT * FROM panel), {fits} " + " UNION ALL ".join(
        f"SELECT month, sec, score0 AS pred FROM t{i} WHERE month = DATE '{m}'" for i, m in enumerate(months)
    )


@ENTRIES.add("m14_walk_forward_of_trees", f"WITH {SUPPLIERS_SQL}, {_tree_walk_sql()}", ["pred"])
def _(spark, sf_dir):
    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    model = learners.boosted_trees(X, "fq_ret", key=KEY, max_depth=2, **{**TREES, "n_estimators": 2})
    # All test months are learnt from and scored; three of them are compared.
    _, pred = learners.predict(model, train, test, KEY, "month", expand_window=True)
    return pred.where(F.col("month").isin([dt.date(1999, m, 1) for m in (1, 5, 9)]))


def _sweep_sql():
    parts = []
    for y in (1998, 1999, 2000):
        parts.append(
            f"""t{y} AS (SELECT * FROM panel WHERE month < DATE '{y}-01-01'),
            {ridge_sql(f't{y}', f'fit{y}', 'fq_ret', 1.0)},
            s{y} AS (SELECT '{y}' AS test_period, -avg(pow(fq_ret - ({PRED_SQL}), 2)) AS mse, -avg(abs(fq_ret - ({PRED_SQL}))) AS mae
              FROM panel, fit{y} WHERE fq_ret IS NOT NULL AND month BETWEEN DATE '{y}-01-01' AND DATE '{y}-12-31')"""
        )
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM s{y}" for y in (1998, 1999, 2000))


@ENTRIES.add("m15_test_period_sweep", f"WITH {SUPPLIERS_SQL}, {_sweep_sql()}", ["mse", "mae"])
def _(spark, sf_dir):
    def study(train, test):
        scored = linear.predict_linear(test, linear.fit_ridge(train, X, "fq_ret", 1.0), X)
        return metrics.evaluate_regressor(scored, "fq_ret").select("mse", "mae")

    periods = [(str(y), f"{y}-01-01", f"{y}-12-31") for y in (1998, 1999, 2000)]
    return learners.sweep_test_periods(supplier_panel(spark, sf_dir), "month", periods, study)


OBJECTIVE_SQL = {
    "mse": ("p - y", "1"),
    "log_square": ("2 * (p - y) / (pow(p - y, 2) + 1)", "-2 * (pow(p - y, 2) - 1) / pow(pow(p - y, 2) + 1, 2)"),
    "mape": ("100 * sign(p - y) / greatest(abs(y), 0.0000001)", "0"),
    "log_abs": ("sign(p - y) / (abs(p - y) + 1)", "-1 / pow(abs(p - y) + 1, 2)"),
    "squared_log": (
        "(ln(1 + c) - ln(1 + y)) / (c + 1)", "(1 - (ln(1 + c) - ln(1 + y))) / pow(c + 1, 2)"
    ),
}


@ENTRIES.add(
    "m16_objective_gradients",
    f"""WITH {SUPPLIERS_SQL}, v AS (SELECT month, sec, fq_ret AS y, x1 / 100 - 0.2 AS p,
      CASE WHEN x1 / 100 - 0.2 < -1 THEN -1 + 0.000001 ELSE x1 / 100 - 0.2 END AS c FROM panel WHERE fq_ret IS NOT NULL)
    SELECT month, sec, {', '.join(f'{g} AS g_{n}, CAST({h} AS DOUBLE) AS h_{n}' for n, (g, h) in OBJECTIVE_SQL.items())} FROM v""",
    [f"{s}_{n}" for n in OBJECTIVE_SQL for s in "gh"],
    digits=6,
)
def _(spark, sf_dir):
    rows = supplier_panel(spark, sf_dir).where("fq_ret is not null")
    y, p = F.col("fq_ret"), F.col("x1") / 100 - 0.2
    columns = []
    for name in OBJECTIVE_SQL:
        g, h = gradients(name, y, p)
        columns += [g.alias(f"g_{name}"), h.alias(f"h_{name}")]
    return rows.select(*KEY, *columns)


@ENTRIES.add("m16_boosting_with_custom_objective")
def _(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    model = fit_boosted(train, X, "fq_ret", "log_square", rounds=5, eta=0.3)
    return model.transform(test).select(*KEY, "pred")


@ENTRIES.add(
    "m16_weighted_median_leaves",
    f"""WITH {SUPPLIERS_SQL}, w AS (SELECT fq_ret AS r, 1 / (abs(fq_ret) + 1) AS w, x1, row_number() OVER () AS id FROM panel WHERE fq_ret IS NOT NULL),
    cut AS (SELECT DISTINCT unnest(quantile_cont(x1, [{', '.join(repr(i / 8) for i in range(1, 8))}])) AS c FROM w),
    side AS (SELECT c, count(*) FILTER (x1 <= c) AS n, -sum(w * sign(r)) AS ga, sum(w / greatest(abs(r), 0.1)) AS ha,
      -sum(w * sign(r)) FILTER (x1 <= c) AS gl, sum(w / greatest(abs(r), 0.1)) FILTER (x1 <= c) AS hl FROM w, cut GROUP BY 1),
    won AS (SELECT c, gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha AS gain FROM side),
    best AS (SELECT c FROM won WHERE gain >= (SELECT max(gain) FROM won) * (1 - 1e-9) ORDER BY c LIMIT 1),
    leaf AS (SELECT CASE WHEN x1 <= c THEN 1 ELSE 2 END AS node, r, w FROM w, best),
    run AS (SELECT *, sum(w) OVER (PARTITION BY node ORDER BY r) AS upto, sum(w) OVER (PARTITION BY node) AS whole FROM leaf)
    SELECT node, min(r) FILTER (upto >= whole / 2) AS value, CAST(count(*) AS DOUBLE) AS cover FROM run GROUP BY 1""",
    ["value", "cover"],
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir).where("fq_ret is not null")
    model = fit_boosted(panel, ["x1"], "fq_ret", "log_abs", rounds=1, eta=1.0, max_depth=1, max_bins=8)
    return model.node_table(spark).where("value IS NOT NULL").select("node", "value", "cover")


@ENTRIES.add(
    "s7_model_save_and_load",
    f"""WITH {SUPPLIERS_SQL}, {trees_sql('panel', 'fit', 'fq_ret', depth=2, train=f"month < DATE '{BEGIN}'", **{**TREES_SQL, 'rounds': 2})}
    SELECT month, sec, score0 AS pred FROM fit WHERE fq_ret IS NOT NULL AND month BETWEEN DATE '{BEGIN}' AND DATE '{END}'""",
    ["pred"],
)
def _(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    path = staging_path(spark, "model")
    model = learners.boosted_trees(X, "fq_ret", key=KEY, max_depth=2, **{**TREES, "n_estimators": 2})
    learners.save_model(model.fit(train), path)
    return learners.load_model(path).transform(test).select(*KEY, "pred")


@ENTRIES.add(
    "s8_batch_scoring",
    f"""WITH {SUPPLIERS_SQL}, {TRAIN_SQL}, {TEST_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 0.0)}
    SELECT sec, x1, DATE '2001-11-01' AS month, {PRED_SQL} AS pred FROM test, fit""",
    ["pred"], digits=7,
)
def _(spark, sf_dir):
    from ..plans.scoring import score_job

    train, _ = sides(spark, sf_dir)
    path = staging_path(spark, "ridge")
    learners.save_model(learners.linear_regression(X, "fq_ret").fit(train), path)
    _, fresh = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    today = F.lit("2001-11-20").cast("date")
    out = score_job(spark, path, fresh.select("sec", *X), "month", staging_path(spark, "scored"), today)
    return out.select("sec", "x1", "month", "pred")


SCORED_SQL = f"""{SUPPLIERS_SQL}, {BOTH_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 1.0)},
p AS (SELECT both_.*, fq_ret AS y, {PRED_SQL} AS pred FROM both_, fit WHERE fq_ret IS NOT NULL)"""


def scored(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return linear.predict_linear(both(train, test), linear.fit_ridge(train, X, "fq_ret", 1.0), X)


E1_SQL = """SELECT split, 1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(y)) AS r2, -avg(pow(y - pred, 2)) AS mse,
-avg(abs(y - pred)) AS mae, -avg(100 * abs(y - pred) / greatest(abs(y), 0.0000001)) AS mape,
-avg(ln(1 + pow(pred - y, 2))) AS mlse FROM p GROUP BY 1"""


@ENTRIES.add("e1_regression_scores", f"WITH {SCORED_SQL} {E1_SQL}", list(metrics.REGRESSION), digits=6)
def _(spark, sf_dir):
    return metrics.evaluate_regressor(scored(spark, sf_dir), "fq_ret", by=["split"]).select("split", *metrics.REGRESSION)


CLASSED_SQL = f"""{SCORED_SQL},
{bin_sql('p', 'c', {'truth': ('y', 3), 'guess': ('pred', 3)}, 'month', 'sec')},
k AS (SELECT split, truth AS cls, count(*) AS support, 0 AS predicted, count(*) FILTER (truth = guess) AS hits FROM c GROUP BY ALL
  UNION ALL SELECT split, guess, 0, count(*), 0 FROM c GROUP BY ALL),
r AS (SELECT split, CAST(cls AS VARCHAR) AS cls, CAST(sum(support) AS BIGINT) AS support, CAST(sum(hits) AS BIGINT) AS hits,
  coalesce(sum(hits) / nullif(sum(predicted), 0), 0) AS precision, coalesce(sum(hits) / nullif(sum(support), 0), 0) AS recall,
  coalesce(2 * sum(hits) / nullif(sum(support) + sum(predicted), 0), 0) AS f1 FROM k GROUP BY ALL)"""


def classified(spark, sf_dir):
    out = discretize_by_month(scored(spark, sf_dir), ["fq_ret", "pred"], 3, "month", ["sec"], suffix="c")
    return out.drop("pred").withColumnsRenamed({"fq_ret_c": "truth", "pred_c": "pred"})


@ENTRIES.add("e2_class_report", f"WITH {CLASSED_SQL} SELECT * FROM r", ["precision", "recall", "f1"])
def _(spark, sf_dir):
    return metrics.class_report(classified(spark, sf_dir), "truth", by=["split"])


@ENTRIES.add(
    "e2_classification_scores",
    f"""WITH {CLASSED_SQL} SELECT split, sum(hits) / sum(support) AS accuracy, avg(precision) AS macro_precision,
    avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision,
    sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM r GROUP BY 1""",
    ["accuracy"] + [f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")],
)
def _(spark, sf_dir):
    return metrics.evaluate_classifier(classified(spark, sf_dir), "truth", by=["split"])


STRATEGY = {"date": "month", "label_fm": "fm_ret", "n_bins": 5, "top": 4, "bottom": 0, "ties": ["sec"]}
E3_SQL = f"""{bin_sql('p', 'q', {'cls': ('pred', 5)}, 'split, month', 'sec')},
tb AS (SELECT split, month, avg(fm_ret) FILTER (cls = 4) - avg(fm_ret) FILTER (cls = 0) AS d FROM q GROUP BY ALL)"""


@ENTRIES.add(
    "e3_top_bottom_strategy",
    f"""WITH {SCORED_SQL}, {E3_SQL} SELECT split, avg(d) AS "Top-Bottom", avg(d) / stddev_samp(d) AS "Top-Bottom-std" FROM tb GROUP BY 1""",
    ["Top-Bottom", "Top-Bottom-std"],
)
def _(spark, sf_dir):
    return metrics.evaluate_top_bottom(scored(spark, sf_dir), by=["split"], **STRATEGY)


@ENTRIES.add(
    "e4_all_scores",
    f"""WITH {SCORED_SQL}, {E3_SQL}, w AS ({E1_SQL}), t AS (SELECT split, avg(d) AS "Top-Bottom",
      avg(d) / stddev_samp(d) AS "Top-Bottom-std" FROM tb GROUP BY 1)
    FROM (UNPIVOT w ON r2, mse, mae, mape, mlse INTO NAME metric VALUE value)
    UNION ALL FROM (UNPIVOT t ON "Top-Bottom", "Top-Bottom-std" INTO NAME metric VALUE value)""",
    ["value"], digits=6,
)
def _(spark, sf_dir):
    return metrics.evaluate_model(scored(spark, sf_dir), "reg", "fq_ret", ["split"], STRATEGY)


@ENTRIES.add(
    "e4_all_class_scores",
    f"""WITH {CLASSED_SQL}, a AS (SELECT split, sum(hits) / sum(support) AS accuracy, avg(precision) AS precision,
      avg(recall) AS recall, avg(f1) AS "f1-score" FROM r GROUP BY 1)
    FROM (UNPIVOT a ON accuracy, precision, recall, "f1-score" INTO NAME metric VALUE value)
    UNION ALL SELECT split, cls || '_f1-score', f1 FROM r UNION ALL SELECT split, cls || '_precision', precision FROM r
    UNION ALL SELECT split, cls || '_recall', recall FROM r""",
    ["value"],
)
def _(spark, sf_dir):
    return metrics.evaluate_model(classified(spark, sf_dir), "cla", "truth", ["split"])


@ENTRIES.add(
    "e5_elementwise_losses",
    f"""WITH {SCORED_SQL} SELECT split, avg(pow(pred - y, 2) / 2) AS half_squared,
    avg(100 * abs(y - pred) / greatest(abs(y), 0.0000001)) AS ape,
    avg(pow(ln(1 + y) - ln(1 + pred), 2)) AS squared_log, avg(ln(1 + abs(pred - y))) AS log_abs,
    avg(ln(1 + pow(pred - y, 2))) AS log_square, sqrt(avg(pow(ln(1 + y) - ln(1 + pred), 2))) AS rmsle FROM p GROUP BY 1""",
    [*LOSSES, "rmsle"], digits=6,
)
def _(spark, sf_dir):
    return metrics.mean_losses(scored(spark, sf_dir), "fq_ret", by=["split"])
