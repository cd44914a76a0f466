"""Choosing among models: ANOVA, post-hoc tests and the preference rule.

Input is a long table (keys, metric, model_id, fold..., value) of validation scores.
Any number of studies (``keys``) and metrics is tested in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_pvalue, range_critical, range_pvalue, t_pvalue
from ..session import settle
from .profile import correlation_matrix


def group_stats(long: DataFrame, keys: Sequence[str], group: str = "model_id") -> DataFrame:
    """Count, mean and sum of squared deviations per (keys, group)."""
    return long.where("value is not null").groupBy(*keys, group).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("ss"),
    )


def anova(long: DataFrame, keys: Sequence[str], group: str = "model_id") -> DataFrame:
    """One-way F statistic with its p-value, per study and metric."""
    stats = group_stats(long, keys, group)
    n, mean = F.col("n"), F.col("mean")
    whole = stats.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
        F.sum("ss").alias("_within"),
        (F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / F.sum("n")).alias("_between"),
    )
    between = F.col("_between") / F.nullif("df_between", F.lit(0))
    within = F.col("_within") / F.nullif("df_within", F.lit(0))
    # Folds that agree exactly: different means are infinitely significant.
    exact = F.when((within == 0) & (between > 0), F.lit(float("inf")))
    out = whole.withColumn("f_stat", F.coalesce(exact, between / F.nullif(within, F.lit(0.0))))
    p = f_pvalue("f_stat", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    infinite = F.col("f_stat") == float("inf")
    return out.select(
        *keys, "df_between", "df_within",
        F.when(infinite, F.col("f_stat")).otherwise(F.round("f_stat", 6)).alias("f_stat"),
        F.when(infinite, F.lit(0.0)).otherwise(F.round(p, 12)).alias("p_value"),
    )


def _pairs(long: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Statistics of every pair of models of a study, from the few rows per model."""
    stats = group_stats(long, keys, group)

    def named(i):
        names = {group: f"group{i}", "n": f"n{i}", "mean": f"mean{i}", "ss": f"ss{i}"}
        return stats.withColumnsRenamed(names)

    joined = named(1).join(named(2), list(keys))
    return joined.where("group1 < group2").withColumn("meandiff", F.col("mean2") - F.col("mean1"))


def t_test(long: DataFrame, keys: Sequence[str], threshold: float, group: str = "model_id"):
    """Pooled two-sample t-test of each pair of models."""
    pairs = _pairs(long, keys, group)
    df = F.col("n1") + F.col("n2") - 2
    pooled = (F.col("ss1") + F.col("ss2")) / F.nullif(df, F.lit(0))
    error = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    out = pairs.withColumn("df", df).withColumn("t_stat", -F.col("meandiff") / F.nullif(error, F.lit(0.0)))
    out = out.withColumn("p_value", t_pvalue("t_stat", F.col("df").cast("double")))
    return out.select(
        *keys, "group1", "group2", "meandiff", "t_stat", "df", "p_value",
        (F.col("p_value") < threshold).alias("reject"),
    )


def tukey(long: DataFrame, keys: Sequence[str], threshold: float, group: str = "model_id"):
    """Tukey's honest significance test of every pair, with its confidence interval."""
    stats = group_stats(long, keys, group)
    whole = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        (F.sum("n") - F.count(F.lit(1))).alias("df"),
        F.sum("ss").alias("_ss"),
    )
    pairs = _pairs(long, keys, group)
    joined = pairs.join(whole, list(keys))
    variance = F.col("_ss") / F.nullif("df", F.lit(0))
    error = F.sqrt(variance / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = joined.withColumn("_se", error)
    out = out.withColumn("q_stat", F.abs("meandiff") / F.nullif("_se", F.lit(0.0)))
    k, df = F.col("k").cast("double"), F.col("df").cast("double")
    out = out.withColumn("p_adj", range_pvalue("q_stat", k, df))
    out = out.withColumn("_crit", range_critical(F.lit(float(threshold)), k, df) * F.col("_se"))
    return out.select(
        *keys, "group1", "group2", "meandiff", "q_stat", "p_adj",
        (F.col("meandiff") - F.col("_crit")).alias("lower"),
        (F.col("meandiff") + F.col("_crit")).alias("upper"),
        (F.col("p_adj") < threshold).alias("reject"),
        "k",
    )


def post_hoc(long: DataFrame, keys: Sequence[str], threshold: float, group: str = "model_id"):
    """The t-test where a study has two models, Tukey's test where it has more."""
    columns = [*keys, "group1", "group2", "meandiff", "reject"]
    counts = group_stats(long, keys, group).groupBy(*keys).agg(F.count(F.lit(1)).alias("_models"))
    sized = long.join(counts, list(keys))
    two = t_test(sized.where("_models = 2"), keys, threshold, group).select(*columns)
    more = tukey(sized.where("_models > 2"), keys, threshold, group).select(*columns)
    return two.unionByName(more)


def most_correlated_metric(
    long: DataFrame, keys: Sequence[str], metrics: Sequence[str], target: str = "Top-Bottom"
) -> DataFrame:
    """The metric whose fold values correlate best with the strategy's, per study."""
    corr = correlation_of_metrics(long, keys, [m for m in metrics if m != target], target)
    best = F.max_by(F.struct("metric", "corr"), F.col("corr")).alias("_b")
    return corr.groupBy(*keys).agg(best).select(*keys, "_b.metric", "_b.corr")


def select_best_model(
    long: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    threshold: float,
    metric_selection: str | None = None,
) -> DataFrame:
    """One row per study: the metric used, the best and the selected model.

    A metric counts if its ANOVA is significant and some pair differs in the post-hoc
    test. Among them one is chosen (by correlation with the strategy, p-value, F,
    the combined z-score, or the order given). Of the models that do not differ from
    the best one in that metric, the one with the lowest id (the most preferred) is
    selected. A study without any such metric falls back to model 0.
    """
    if not keys:
        one = long.withColumn("study", F.lit("all"))
        return select_best_model(one, ["study"], metrics, threshold, metric_selection).drop("study")
    keys = list(keys)
    by = [*keys, "metric"]
    # Scores are models x folds x metrics rows; several tests read them.
    long = settle(long)
    tests = anova(long, by)
    pairs = post_hoc(long, by, threshold)
    passing = tests.where(F.col("p_value") < threshold).join(
        pairs.where("reject").select(*by).distinct(), by, "left_semi"
    )
    listed = list(metrics)
    order = F.array_position(F.array(*[F.lit(m) for m in listed]), F.col("metric"))
    wanted = passing.where(F.col("metric").isin(listed)).withColumn("_order", order)
    if metric_selection == "corr":
        corr = correlation_of_metrics(long, keys, listed)
        # The strategy's own score needs no stand-in: where it passes, it is the choice.
        own = F.when(F.col("metric") == "Top-Bottom", F.lit(2.0))
        rank = F.struct(F.coalesce(own, "corr", F.lit(-2.0)), -F.col("_order"))
        wanted = wanted.join(corr, by, "left")
    elif metric_selection == "p":
        rank = F.struct(-F.col("p_value"), -F.col("_order"))
    elif metric_selection == "f":
        rank = F.struct(F.col("f_stat"), -F.col("_order"))
    else:
        rank = F.struct(-F.col("_order"))
    if metric_selection == "combined":
        combined = passing.where("metric = 'combined_zscore'").join(
            wanted.select(*keys).distinct(), keys, "left_semi"
        )
        wanted = wanted.unionByName(combined.withColumn("_order", F.lit(0).cast("bigint")))
    chosen = wanted.groupBy(*keys).agg(F.max_by("metric", rank).alias("metric"))
    means = long.groupBy(*by, "model_id").agg(F.avg("value").alias("mean"))
    best = means.join(chosen, by).groupBy(*by).agg(
        F.max_by("model_id", F.struct("mean", -F.col("model_id"))).alias("id_best")
    )
    near = pairs.where("not reject").join(best, by).where(
        (F.col("group1") == F.col("id_best")) | (F.col("group2") == F.col("id_best"))
    )
    lowest = near.groupBy(*keys).agg(F.min(F.least("group1", "group2")).alias("_low"))
    out = long.select(*keys).distinct().join(best, keys, "left").join(lowest, keys, "left")
    selected = F.coalesce("_low", "id_best", F.lit(0)).alias("id_selected")
    return out.select(*keys, "metric", "id_best", selected)


def correlation_of_metrics(
    long: DataFrame, keys: Sequence[str], metrics: Sequence[str], target: str = "Top-Bottom"
) -> DataFrame:
    """(keys, metric, corr) of every metric with the strategy's score."""
    wide = long.groupBy(*keys, "model_id", "epoch", "fold").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
            for m in dict.fromkeys([*metrics, target])
        ]
    )
    corr = correlation_matrix(wide, list(dict.fromkeys([*metrics, target])), keys)
    return corr.where((F.col("y") == target) & (F.col("x") != target)).select(
        *keys, F.col("x").alias("metric"), "corr"
    )
