"""Purged cross-validation, grid search and combined scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from ..operators import crossval, learners, linear
from ..operators.bins import rank_predictions
from ..operators.returns import calculate_diff_return, calculate_return, latest_row
from ..operators.splits import month_span, val_dates
from ..plans.panels import supplier_panel
from .base import Register, SUPPLIERS_SQL, bin_sql, returns_sql, ridge_sql, spread_sql, trees_sql
from .learning import BOTH_SQL, KEY, STRATEGY, TREES, TREES_SQL, X, both, class_sides, sides

ENTRIES = Register()
ALPHAS = [0.1, 100.0, 10000.0]
RULE = {"purge_length": 3, "embargo_length": 1, "train_from_future": True}


def ridge_search(spark, sf_dir, n_epoch=1, subsample=1.0):
    panel = supplier_panel(spark, sf_dir)
    folds = val_dates(*month_span(panel, "month"), 3)
    return crossval.ridge_cv(
        panel, "month", KEY, X, "fq_ret", ALPHAS, folds, strategy=STRATEGY, n_epoch=n_epoch,
        subsample=subsample, **RULE,
    )


FOLDS_SQL = """span AS (SELECT min(month) AS b, max(month) AS e FROM panel),
len AS (SELECT *, CAST(floor(date_diff('month', b, e) / CAST(3 AS DOUBLE) + 1) AS INTEGER) AS l FROM span),
folds AS (SELECT CAST(i AS INTEGER) AS fold, CAST(b + to_months(CAST(i * l AS INTEGER)) AS DATE) AS vb,
  CASE WHEN i = 2 THEN e ELSE CAST(b + to_months(CAST((i + 1) * l - 1 AS INTEGER)) AS DATE) END AS ve
  FROM len, range(3) t(i)),
used AS (SELECT p.*, fold, CASE WHEN month BETWEEN vb AND ve THEN 'val'
  WHEN month BETWEEN vb - INTERVAL 3 MONTH AND vb - INTERVAL 1 MONTH THEN NULL
  WHEN month BETWEEN ve + INTERVAL 1 MONTH AND ve + INTERVAL 4 MONTH THEN NULL ELSE 'train' END AS partition
  FROM panel p, folds),
trains AS (SELECT * FROM used WHERE partition = 'train')"""

FITS_SQL = ", ".join(ridge_sql("trains", f"fit{i}", "fq_ret", a, "fold") for i, a in enumerate(ALPHAS))
CV_SQL = f"""{SUPPLIERS_SQL}, {FOLDS_SQL}, {FITS_SQL},
fits AS ({' UNION ALL '.join(f'SELECT {i} AS model_id, * FROM fit{i}' for i in range(3))}),
p AS (SELECT model_id, 0 AS epoch, fold, partition, month, sec, fm_ret, fq_ret AS y,
  intercept + b1 * x1 + b2 * x2 AS pred FROM used JOIN fits USING (fold)
  WHERE partition IS NOT NULL AND fq_ret IS NOT NULL),
{bin_sql('p', 'q', {'cls': ('pred', 5)}, 'model_id, fold, partition, month', 'sec')},
tb AS (SELECT model_id, epoch, fold, partition, month, avg(fm_ret) FILTER (cls = 4) - avg(fm_ret) FILTER (cls = 0) AS d
  FROM q GROUP BY ALL),
w AS (SELECT model_id, epoch, fold, partition, 1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(y)) AS r2,
  -avg(pow(y - pred, 2)) AS mse, -avg(abs(y - pred)) AS mae,
  -avg(100 * abs(y - pred) / greatest(abs(y), 0.0000001)) AS mape, -avg(ln(1 + pow(pred - y, 2))) AS mlse
  FROM p GROUP BY ALL),
t AS (SELECT model_id, epoch, fold, partition, avg(d) AS "Top-Bottom", avg(d) / stddev_samp(d) AS "Top-Bottom-std"
  FROM tb GROUP BY ALL),
cv AS (FROM (UNPIVOT w ON r2, mse, mae, mape, mlse INTO NAME metric VALUE value)
  UNION ALL FROM (UNPIVOT t ON "Top-Bottom", "Top-Bottom-std" INTO NAME metric VALUE value))"""


@ENTRIES.add("v1_purged_cross_validation", f"WITH {CV_SQL} SELECT * FROM cv", ["value"], digits=6)
def _(spark, sf_dir):
    return ridge_search(spark, sf_dir)


@ENTRIES.add("v1_cross_validation_with_epochs")
def _(spark, sf_dir):
    return ridge_search(spark, sf_dir, n_epoch=3, subsample=0.7)


SUMMARY_SQL = f"""{CV_SQL}, summary AS (SELECT model_id, partition, metric, avg(value) AS mean, stddev_pop(value) AS std
  FROM cv GROUP BY ALL)"""


@ENTRIES.add("v2_grid_search", f"WITH {SUMMARY_SQL} SELECT * FROM summary", ["mean", "std"], digits=6)
def _(spark, sf_dir):
    return crossval.summarize_cv(ridge_search(spark, sf_dir)).drop("values")


@ENTRIES.add(
    "v2_grid_search_wide",
    f"WITH {SUMMARY_SQL} SELECT model_id, "
    + ", ".join(
        f"max({c}) FILTER (metric = '{m}' AND partition = '{p}') AS \"{m}_{p}_{c}\""
        for m in ("r2", "mae") for p in ("train", "val") for c in ("mean", "std")
    )
    + " FROM summary GROUP BY 1",
    [f"{m}_{p}_{c}" for m in ("r2", "mae") for p in ("train", "val") for c in ("mean", "std")],
    digits=7,
)
def _(spark, sf_dir):
    wide = crossval.wide_cv(crossval.summarize_cv(ridge_search(spark, sf_dir)), ["r2", "mae"])
    return wide.drop(*[c for c in wide.columns if c.endswith("_values")])


def _tree_search_sql():
    """Fold by fold and depth by depth: the trees of the training months score both sides."""
    fits, parts = [], []
    for f in range(2):
        fits.append(f"f{f} AS (SELECT * FROM used WHERE fold = {f} AND partition IS NOT NULL AND fq_ret IS NOT NULL)")
        for d in (1, 2):
            own = trees_sql(f"f{f}", f"t{f}_{d}", "fq_ret", depth=d, train="partition = 'train'", **TREES_SQL)
            # Factors are cut once for all folds.
            own = own.replace(f"FROM t{f}_{d}_id WHERE fit)", "FROM panel WHERE fq_ret IS NOT NULL)")
            fits.append(own)
            parts.append(f"SELECT {d - 1} AS model_id, fold, partition, fq_ret AS y, score0 AS pred FROM t{f}_{d}")
    folds = FOLDS_SQL.replace("/ CAST(3 AS DOUBLE)", "/ CAST(2 AS DOUBLE)").replace("i = 2", "i = 1").replace("range(3)", "range(2)")
    span = folds.replace("FROM panel),\nlen", "FROM panel WHERE fq_ret IS NOT NULL),\nlen")
    return f"""{SUPPLIERS_SQL}, {span}, {', '.join(fits)}, p AS ({' UNION ALL '.join(parts)}),
    w AS (SELECT model_id, fold, partition, 1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(y)) AS r2,
      -avg(pow(y - pred, 2)) AS mse, -avg(abs(y - pred)) AS mae,
      -avg(100 * abs(y - pred) / greatest(abs(y), 0.0000001)) AS mape, -avg(ln(1 + pow(pred - y, 2))) AS mlse FROM p GROUP BY ALL),
    cv AS (FROM (UNPIVOT w ON r2, mse, mae, mape, mlse INTO NAME metric VALUE value))"""


@ENTRIES.add(
    "v2_grid_search_of_trees",
    f"""WITH {_tree_search_sql()} SELECT model_id, partition, metric, avg(value) AS mean, stddev_pop(value) AS std FROM cv GROUP BY ALL""",
    ["mean", "std"], digits=6,
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir).where("fq_ret is not null")
    folds = val_dates(*month_span(panel, "month"), 2)

    def make(params):
        return learners.boosted_trees(X, "fq_ret", key=KEY, **TREES, **params)

    long = crossval.estimator_cv(
        panel, "month", KEY, "fq_ret", make, [{"max_depth": 1}, {"max_depth": 2}], folds, "reg", **RULE
    )
    return crossval.summarize_cv(long).drop("values")


ZSCORE_SQL = f"""{CV_SQL}, z AS (SELECT *, (value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0) AS zscore
  FROM cv WHERE metric IN ('mae', 'mlse', 'Top-Bottom') WINDOW g AS (PARTITION BY partition, metric))"""
SCORES = ["mae", "mlse", "Top-Bottom"]


@ENTRIES.add("v3_standardized_metrics", f"WITH {ZSCORE_SQL} SELECT * FROM z", ["value", "zscore"], digits=6)
def _(spark, sf_dir):
    return crossval.standardize_metrics(ridge_search(spark, sf_dir), SCORES)


@ENTRIES.add(
    "v4_combined_metric",
    f"""WITH {ZSCORE_SQL}, c AS (SELECT model_id, epoch, fold, partition, avg(zscore) AS value FROM z GROUP BY ALL)
    SELECT model_id, partition, avg(value) AS mean, stddev_samp(value) AS std FROM c GROUP BY ALL""",
    ["mean", "std"], digits=6,
)
def _(spark, sf_dir):
    return crossval.combined_summary(crossval.combined_metric(ridge_search(spark, sf_dir), SCORES))


def _penalised_sql():
    fits = ", ".join(ridge_sql("train", f"fit{i}", "fq_ret", a) for i, a in enumerate(ALPHAS))
    return f"""{SUPPLIERS_SQL}, {BOTH_SQL}, {fits},
    fits AS ({' UNION ALL '.join(f'SELECT {i} AS model_id, * FROM fit{i}' for i in range(3))}),
    p AS (SELECT model_id, both_.*, intercept + b1 * x1 + b2 * x2 AS pred FROM both_, fits WHERE fq_ret IS NOT NULL),
    {bin_sql('p', 'q', {'cls': ('pred', 5)}, 'model_id, split, month', 'sec')},
    {returns_sql('q', '', 'cls', range(5), 'fm_ret', 'model_id, split')}, {spread_sql('', 4, 0, 'model_id, split')},
    l AS (SELECT model_id, split, arg_max(cumulative_return_diff, month) AS d FROM spread GROUP BY ALL),
    s AS (SELECT model_id, max(d) FILTER (split = 'train') AS train_diff, max(d) FILTER (split = 'test') AS val_diff FROM l GROUP BY 1)"""


@ENTRIES.add(
    "v5_overfit_penalised_search",
    f"""WITH {_penalised_sql()} SELECT model_id, train_diff, val_diff, val_diff - abs(train_diff - val_diff) AS metric FROM s""",
    ["train_diff", "val_diff", "metric"], digits=8,
)
def _(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    sets = linear.moments(train, X, "fq_ret").withColumn(
        "m", F.explode(F.array(*[F.struct(F.lit(i).alias("model_id"), F.lit(a).alias("alpha")) for i, a in enumerate(ALPHAS)]))
    )
    fits = linear.solve_ridge(sets.select("*", "m.*"), 2, F.col("alpha"))
    models = fits.agg(F.collect_list(F.struct("model_id", "intercept", "coef_0", "coef_1")).alias("m"))
    from ..session import attach

    rows = attach(both(train, test), models, []).select("*", F.explode("m").alias("f")).select("*", "f.*")
    pred = rows.withColumn("pred", linear.linear_score(X)).drop("m", "f")
    keys = ["model_id", "split"]
    ranked = rank_predictions(pred, 5, [*keys, "month"], ["sec"])
    cum = calculate_return(ranked, "month", "pred_rank", range(5), "fm_ret", keys)
    spread = calculate_diff_return(cum, "month", "pred_rank", 4, 0, keys)
    last = latest_row(spread, "month", keys).withColumnRenamed("cumulative_return_diff", "diff")
    return crossval.overfit_penalised(last)


@ENTRIES.add("v6_cross_validator_macro_f1")
def _(spark, sf_dir):
    train, test = class_sides(spark, sf_dir)
    assemble = VectorAssembler(inputCols=X, outputCol="features")
    model = LogisticRegression(labelCol="fq_ret_cls", family="multinomial", maxIter=10)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 0.1]).build()
    best = crossval.grid_search_cv(assemble.transform(train), model, grid, "fq_ret_cls", 2)
    return best.transform(assemble.transform(test)).select(*KEY, F.col("prediction").alias("pred"))
