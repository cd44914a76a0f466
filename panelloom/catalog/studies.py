"""Whole studies and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners, linear
from ..operators.crossval import summarize_cv
from ..operators.rolling import dense_means, lag_difference, reversal_flag, rolling_mean
from ..plans.panels import market_series, supplier_panel
from ..plans.prepare import PrepareConfig, prepare_panel
from ..plans.scoring import drift_job
from ..plans.study import StudyConfig, join_predictions, run_study, save_summary
from ..session import staging_path
from .base import MARKET_SQL, Register, SUPPLIERS_SQL, bin_sql, returns_sql, ridge_sql, spread_sql, trees_sql
from .cleaning import SUPPLIER_GAPS_SQL, supplier_gaps
from .joins import PAIRS, PARTS, PERIODS, _periods_sql, binned
from .learning import BEGIN, BOTH_SQL, E1_SQL, E3_SQL, END, KEY, PRED_SQL, TREES, TREES_SQL, X, classed
from .searching import CV_SQL, ridge_search

ENTRIES = Register()
SPREAD_COLUMNS = ["cumulative_return_diff", "annual_return_diff", "std_diff", "IR"]


def ridge_config(**changes):
    base = {
        "date": "month", "key": ["sec"], "features": X, "label": "fq_ret", "label_fm": "fm_ret",
        "test_begin": BEGIN, "test_end": END, "param_grid": {"alpha": [1.0]},
        "train_from_future": False, "step": 2.0,
    }
    return StudyConfig(**{**base, **changes})


def _study_sql(blend=""):
    return f"""{SUPPLIERS_SQL}, {BOTH_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 1.0)},
    p AS (SELECT both_.*, {PRED_SQL} AS pred FROM both_, fit),
    {blend}{bin_sql('u', 'r', {'cls': ('used', 5)}, 'split, month', 'sec')},
    {returns_sql('r', '', 'cls', range(5), 'fm_ret', 'split')}, {spread_sql('', 4, 0, 'split')}"""


PLAIN = "u AS (SELECT *, pred AS used FROM p), "
BLENDED = (
    "e AS (SELECT p.*, fm_ret AS edge, fq_ret + fm_ret AS total FROM p), etrain AS (SELECT * FROM e WHERE split = 'train'), "
    + ridge_sql("etrain", "w", "total", 0.0, intercept=False, x=("pred", "edge"))
    + ", u AS (SELECT e.*, w.b1 * pred + w.b2 * edge AS used FROM e, w), "
)


@ENTRIES.add("n1_regression_study_backtest", f"WITH {_study_sql(PLAIN)} SELECT * FROM spread", SPREAD_COLUMNS, digits=8)
def _(spark, sf_dir):
    return run_study(spark, ridge_config(), supplier_panel(spark, sf_dir))["backtest_diff"]


@ENTRIES.add(
    "n1_regression_study_surface",
    f"""WITH {_study_sql(PLAIN)}, l AS (SELECT min(x1) AS a, max(x1) AS b, min(x2) AS c, max(x2) AS d FROM train),
    gx AS (SELECT a + unnest(range(CAST(ceil((b - a) / 2) AS BIGINT))) * CAST(2 AS DOUBLE) AS x1 FROM l),
    gy AS (SELECT c + unnest(range(CAST(ceil((d - c) / 2) AS BIGINT))) * CAST(2 AS DOUBLE) AS x2 FROM l)
    SELECT x1, x2, {PRED_SQL} AS pred FROM gx, gy, fit""",
    ["x1", "x2", "pred"], digits=7,
)
def _(spark, sf_dir):
    return run_study(spark, ridge_config(), supplier_panel(spark, sf_dir))["surface"]


TREE_STUDY_SQL = f"""{SUPPLIERS_SQL}, {BOTH_SQL.replace("FROM panel WHERE", "FROM panel WHERE fq_ret IS NOT NULL AND")},
{trees_sql('both_', 'fit', 'fq_ret', depth=2, train="split = 'train'", **TREES_SQL)},
p AS (SELECT *, fq_ret AS y, score0 AS pred FROM fit), {E3_SQL}, w AS ({E1_SQL}),
t AS (SELECT split, avg(d) AS "Top-Bottom", avg(d) / stddev_samp(d) AS "Top-Bottom-std" FROM tb GROUP BY 1)
FROM (UNPIVOT w ON r2, mse, mae, mape, mlse INTO NAME metric VALUE value)
UNION ALL FROM (UNPIVOT t ON "Top-Bottom", "Top-Bottom-std" INTO NAME metric VALUE value)"""


@ENTRIES.add("n1_tree_study_scores", f"WITH {TREE_STUDY_SQL}", ["value"], digits=6)
def _(spark, sf_dir):
    def make(params):
        return learners.boosted_trees(X, "fq_ret", key=KEY, **TREES, **params)

    config = ridge_config(make=make, param_grid={"max_depth": [2]}, k=2)
    panel = supplier_panel(spark, sf_dir).where("fq_ret is not null")
    return run_study(spark, config, panel, staging_path(spark, "study"), "trees")["model_evaluation"]


@ENTRIES.add("n1_walk_forward_study_backtest")
def _(spark, sf_dir):
    config = ridge_config(expand_window=True, param_grid={"alpha": [1.0, 1000.0]})
    return run_study(spark, config, supplier_panel(spark, sf_dir))["backtest_diff"]


@ENTRIES.add("n2_residual_study_backtest", f"WITH {_study_sql(BLENDED)} SELECT * FROM spread", SPREAD_COLUMNS, digits=8)
def _(spark, sf_dir):
    config = ridge_config(edge="fm_ret")
    return run_study(spark, config, supplier_panel(spark, sf_dir))["backtest_diff"]


def _class_study(spark, sf_dir, rank, result):
    def make(params):
        return learners.logistic(X, "fq_ret_cls", **params)

    config = ridge_config(
        kind="cla", label="fq_ret_cls", make=make, param_grid={"c": [1.0]}, k=2, n_bins=3, top=2,
        rank=rank, cv_metrics=("f1-score",),
    )
    return run_study(spark, config, classed(spark, sf_dir))[result]


@ENTRIES.add("n3_classification_study_scores")
def _(spark, sf_dir):
    return _class_study(spark, sf_dir, False, "model_evaluation")


@ENTRIES.add("n4_ranked_classification_study_backtest")
def _(spark, sf_dir):
    return _class_study(spark, sf_dir, True, "backtest_diff")


@ENTRIES.add(
    "n5_prepared_panel",
    f"""WITH {SUPPLIER_GAPS_SQL}, t AS (SELECT * FROM gaps WHERE fq_ret IS NOT NULL),
    lim AS (SELECT month, quantile_cont(x1, 0.03) AS lo, quantile_cont(x1, 0.97) AS hi FROM t GROUP BY 1),
    w AS (SELECT t.month, sec, fq_ret, CASE WHEN x1 IS NOT NULL THEN greatest(least(x1, hi), lo) END AS x1 FROM t JOIN lim USING (month)),
    s AS (SELECT month, avg(x1) AS m, stddev_samp(x1) AS d FROM w GROUP BY 1),
    z AS (SELECT w.month, sec, fq_ret, coalesce((x1 - m) / nullif(d, 0), 0) AS x1 FROM w JOIN s USING (month)),
    {bin_sql('z', 'b', {'fq_ret_tertile': ('fq_ret', 3), 'fq_ret_quintile': ('fq_ret', 5)}, 'month', 'sec')}
    SELECT month, sec, x1, fq_ret_tertile, fq_ret_quintile FROM b""",
    ["x1"],
)
def _(spark, sf_dir):
    config = PrepareConfig(
        "month", ["sec"], ["x1"], targets=["fq_ret"], finite=["x1", "fq_ret"], winsorize=(0.03, 0.97),
        standardize="mean", bins=[("fq_ret", 3, "tertile"), ("fq_ret", 5, "quintile")],
    )
    out = prepare_panel(supplier_gaps(spark, sf_dir), config)
    return out.select("month", "sec", "x1", "fq_ret_tertile", "fq_ret_quintile")


@ENTRIES.add(
    "n6_drift_densities",
    f"""WITH {SUPPLIERS_SQL}, per AS (FROM (VALUES {_periods_sql()}) t(period, b, e)),
    d AS (SELECT period AS "Dataset", x1, x2 FROM panel JOIN per ON month BETWEEN b AND e
      UNION ALL SELECT 'fresh', x1, x2 FROM panel WHERE month >= DATE '2001-01-01'),
    u AS (UNPIVOT d ON x1, x2 INTO NAME feature VALUE v),
    lim AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1),
    h AS (SELECT feature, "Dataset", CAST(least(floor((v - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n,
      any_value(lo) AS lo, any_value((hi - lo) / 30) AS width FROM u JOIN lim USING (feature) GROUP BY ALL)
    SELECT feature, "Dataset", bin, n, lo + bin * width AS "left",
    n / (sum(n) OVER (PARTITION BY feature, "Dataset") * width) AS density FROM h""",
    ["left", "density"], digits=7,
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    fresh = panel.where("month >= date'2001-01-01'")
    return drift_job(panel, fresh, "month", X, PERIODS, 30)


@ENTRIES.add(
    "regime_classification_panel",
    f"""WITH {PAIRS}, {MARKET_SQL}, s AS (SELECT month, max(CASE WHEN grp = 'x1 4; x2 4' THEN v END)
      - max(CASE WHEN grp = 'x1 0; x2 0' THEN v END) AS spread FROM r GROUP BY 1),
    f AS (SELECT month, CAST(coalesce(spread > 0, FALSE) AS INTEGER) AS reversal FROM s),
    j AS (SELECT month, level, reversal, level - lag(level, 3) OVER (ORDER BY month) AS level_diff
      FROM market LEFT JOIN f USING (month))
    SELECT * FROM j WHERE reversal IS NOT NULL AND level_diff IS NOT NULL""",
    ["level", "level_diff"],
)
def _(spark, sf_dir):
    from ..functions.scalars import group_label

    rows = binned(spark, sf_dir, ("x1", "x2")).withColumn("grp", group_label(PARTS))
    rolled = rolling_mean(dense_means(rows, "month", "grp", "fm_ret"), "month", "fm_ret", 6, ["grp"])
    flag = reversal_flag(rolled, "month", "grp", "fm_ret_roll", "x1 4; x2 4", "x1 0; x2 0")
    market = market_series(spark, sf_dir).select("month", "level")
    joined = market.join(flag.select("month", "reversal"), "month", "left")
    return lag_difference(joined, "month", ["level"], 3).na.drop()


@ENTRIES.add(
    "l8_selected_model_summary",
    f"""WITH {CV_SQL}, b AS (SELECT arg_max(model_id, m) AS id FROM (SELECT model_id, avg(value) AS m FROM cv
      WHERE partition = 'val' AND metric = 'mse' GROUP BY 1))
    SELECT model_id, partition, metric, avg(value) AS mean, stddev_pop(value) AS std FROM cv, b WHERE model_id = id GROUP BY ALL""",
    ["mean", "std"], digits=6,
)
def _(spark, sf_dir):
    from ..operators.crossval import best_model
    from ..session import settle

    long = settle(ridge_search(spark, sf_dir))
    means = long.where("partition = 'val' and metric = 'mse'").groupBy("model_id").agg(F.avg("value").alias("m"))
    best = best_model(means, "m").withColumnRenamed("model_id", "id_selected")
    return save_summary(summarize_cv(long), best)


@ENTRIES.add(
    "l9_predictions_of_several_models",
    f"""WITH {SUPPLIERS_SQL}, {BOTH_SQL}, {ridge_sql('train', 'fit', 'fq_ret', 1.0)}, {ridge_sql('train', 'fitb', 'fq_ret', 1000.0)}
    SELECT month, sec, fit.intercept + fit.b1 * x1 + fit.b2 * x2 AS "Pred_x1_x2_light",
    fitb.intercept + fitb.b1 * x1 + fitb.b2 * x2 AS "Pred_x1_x2_heavy" FROM test, fit, fitb""",
    ["Pred_x1_x2_light", "Pred_x1_x2_heavy"],
)
def _(spark, sf_dir):
    from ..operators.splits import train_test_split_by_date

    train, test = train_test_split_by_date(supplier_panel(spark, sf_dir), "month", BEGIN, END)
    parts = []
    for name, alpha in (("light", 1.0), ("heavy", 1000.0)):
        coefs = linear.fit_ridge(train, X, "fq_ret", alpha)
        parts.append(linear.predict_linear(test, coefs, X).select(*KEY, "pred").withColumn("model", F.lit(name)))
    return join_predictions(
        test.select(*KEY), parts[0].unionByName(parts[1]), KEY, X, ["light", "heavy"]
    )


