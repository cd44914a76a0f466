"""ANOVA, post-hoc tests and model selection on measured scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from .base import Register, SUPPLIERS_SQL, bin_sql
from .joins import binned
from .searching import CV_SQL, ridge_search

ENTRIES = Register()
# Each sector is a study; the quintiles of a factor compete, years are their folds.
SCORES_SQL = f"""{SUPPLIERS_SQL}, {bin_sql('panel', 'binned', {'model_id': ('x1', 5)}, 'month', 'sec')},
long AS (SELECT sector, model_id, year(month) AS fold, avg(fm_ret) AS value FROM binned GROUP BY ALL),
g AS (SELECT sector, model_id, count(value) AS n, avg(value) AS mean, var_pop(value) * count(value) AS ss
  FROM long GROUP BY ALL),
a AS (SELECT sector, count(*) AS k, sum(n) - count(*) AS df, sum(ss) AS ssw,
  sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n) AS ssb FROM g GROUP BY 1)"""


def scores(spark, sf_dir):
    rows = binned(spark, sf_dir).withColumn("fold", F.year("month"))
    return rows.groupBy("sector", F.col("x1_bin").alias("model_id"), "fold").agg(
        F.avg("fm_ret").alias("value")
    )


@ENTRIES.add(
    "h1_anova",
    f"""WITH {SCORES_SQL} SELECT sector, CAST(k - 1 AS BIGINT) AS df_between, CAST(df AS BIGINT) AS df_within,
    round((ssb / (k - 1)) / (ssw / df), 6) AS f_stat FROM a""",
)
def _(spark, sf_dir):
    return selection.anova(scores(spark, sf_dir), ["sector"]).drop("p_value")


@ENTRIES.add("h1_anova_p_values")
def _(spark, sf_dir):
    return selection.anova(scores(spark, sf_dir), ["sector"])


@ENTRIES.add(
    "h2_two_sample_t_test",
    f"""WITH {SCORES_SQL}, p AS (SELECT a.sector, a.model_id AS group1, b.model_id AS group2, b.mean - a.mean AS meandiff,
      CAST(a.n + b.n - 2 AS BIGINT) AS df, (a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n) AS v
      FROM g a JOIN g b USING (sector) WHERE a.model_id = 0 AND b.model_id = 4)
    SELECT sector, group1, group2, meandiff, df, -meandiff / sqrt(v) AS t_stat FROM p""",
    ["meandiff", "t_stat"],
)
def _(spark, sf_dir):
    ends = scores(spark, sf_dir).where("model_id in (0, 4)")
    return selection.t_test(ends, ["sector"], 0.05).drop("p_value", "reject")


TUKEY_SQL = f"""{SCORES_SQL}, p AS (SELECT x.sector, x.model_id AS group1, y.model_id AS group2,
  y.mean - x.mean AS meandiff, abs(y.mean - x.mean) / sqrt(ssw / df / 2 * (1.0 / x.n + 1.0 / y.n)) AS q_stat
  FROM g x JOIN g y USING (sector) JOIN a USING (sector) WHERE x.model_id < y.model_id)"""


@ENTRIES.add("h3_tukey_statistics", f"WITH {TUKEY_SQL} SELECT * FROM p", ["meandiff", "q_stat"])
def _(spark, sf_dir):
    return selection.tukey(scores(spark, sf_dir), ["sector"], 0.05).select(
        "sector", "group1", "group2", "meandiff", "q_stat"
    )


@ENTRIES.add("h3_post_hoc_test")
def _(spark, sf_dir):
    return selection.post_hoc(scores(spark, sf_dir), ["sector"], 0.05)


@ENTRIES.add(
    "h4_most_correlated_metric",
    f"""WITH {CV_SQL}, v AS (SELECT * FROM cv WHERE partition = 'val'),
    c AS (SELECT a.metric, corr(a.value, b.value) AS corr FROM v a JOIN v b USING (model_id, epoch, fold)
      WHERE b.metric = 'Top-Bottom' AND a.metric IN ('r2', 'mae', 'mape') GROUP BY 1)
    SELECT arg_max(metric, corr) AS metric, max(corr) AS corr FROM c""",
    ["corr"], digits=6,
)
def _(spark, sf_dir):
    val = ridge_search(spark, sf_dir).where("partition = 'val'")
    return selection.most_correlated_metric(val, [], ["r2", "mae", "mape"])


@ENTRIES.add("h5_select_best_model")
def _(spark, sf_dir):
    val = ridge_search(spark, sf_dir).where("partition = 'val'")
    return selection.select_best_model(val, [], ["r2", "mae"], 0.05)


@ENTRIES.add("h5_select_per_sector")
def _(spark, sf_dir):
    long = scores(spark, sf_dir).select(
        "sector", F.lit("mean_return").alias("metric"), "model_id", F.lit(0).alias("epoch"), "fold", "value"
    )
    return selection.select_best_model(long, ["sector"], ["mean_return"], 0.2)
