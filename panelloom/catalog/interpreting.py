"""Tables behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interpret, learners, linear
from ..operators.profile import correlation_matrix
from ..plans.panels import market_series, row_panel, supplier_panel
from .base import MARKET_SQL, ROWS_SQL, Register, SUPPLIERS_SQL, ridge_sql, trees_sql, walk_sql
from .learning import (
    CLASSED_PANEL_SQL, GAPS_SQL, KEY, SCORED_SQL, STEPS, TREES, TREES_SQL, X, class_sides, rest_sql, scored, with_gaps,
)
from .searching import ALPHAS, CV_SQL, ridge_search

ENTRIES = Register()


def _hist_sql(source, value, n, by="", frame=""):
    b = f"{by}, " if by else ""
    j = f"JOIN e USING ({frame})" if frame else ", e"
    f = f"{frame}, " if frame else ""
    g = f" GROUP BY {frame}" if frame else ""
    return f"""e AS (SELECT {f}min({value}) AS lo, max({value}) AS hi FROM {source}{g}),
    h AS (SELECT {b}CAST(least(coalesce(floor(({value} - lo) * {n} / nullif(hi - lo, 0)), 0), {n - 1}) AS INTEGER) AS bin,
      count(*) AS n, any_value(lo) AS lo, any_value((hi - lo) / {n}) AS width
      FROM {source} {j} WHERE {value} IS NOT NULL GROUP BY {b}bin)"""


@ENTRIES.add(
    "i1_histogram",
    f"""WITH {ROWS_SQL}, {_hist_sql('rows_', 'price', 20)} SELECT bin, n, lo + bin * width AS "left" FROM h""",
    ["left"], digits=6,
)
def _(spark, sf_dir):
    return interpret.histogram(row_panel(spark, sf_dir), "price", 20)


@ENTRIES.add(
    "i1_spread_marks",
    f"WITH {SUPPLIERS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, avg({c}) - 2 * stddev_samp({c}) AS low, avg({c}) + 2 * stddev_samp({c}) AS high FROM panel"
        for c in ("x1", "fm_ret")
    ),
    ["mean", "low", "high"],
)
def _(spark, sf_dir):
    return interpret.spread_marks(supplier_panel(spark, sf_dir), ["x1", "fm_ret"])


@ENTRIES.add(
    "i2_density_by_group_and_hue",
    f"""WITH {SUPPLIERS_SQL}, {_hist_sql('panel', 'x1', 15, 'sector, member', 'sector')}
    SELECT sector, member, bin, n, lo + bin * width AS "left",
    n / nullif(sum(n) OVER (PARTITION BY sector, member) * width, 0) AS density FROM h""",
    ["left", "density"], digits=7,
)
def _(spark, sf_dir):
    return interpret.histogram(
        supplier_panel(spark, sf_dir), "x1", 15, ["sector", "member"], density=True, common_over=["member"]
    )


@ENTRIES.add(
    "i3_box_statistics",
    f"""WITH {SUPPLIERS_SQL}, q AS (SELECT sector, quantile_cont(fm_ret, 0.25) AS q1, median(fm_ret) AS q2,
      quantile_cont(fm_ret, 0.75) AS q3 FROM panel GROUP BY 1),
    f AS (SELECT p.sector, fm_ret, q1, q2, q3, fm_ret BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS ok
      FROM panel p JOIN q USING (sector))
    SELECT sector, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, avg(fm_ret) AS mean,
    min(fm_ret) FILTER (ok) AS low_whisker, max(fm_ret) FILTER (ok) AS high_whisker,
    count(*) FILTER (NOT ok) AS n_outliers FROM f GROUP BY 1""",
    ["q1", "q2", "q3", "mean", "low_whisker", "high_whisker"],
)
def _(spark, sf_dir):
    return interpret.box_statistics(supplier_panel(spark, sf_dir), ["sector"], "fm_ret")


@ENTRIES.add(
    "i4_fitted_line",
    f"""WITH {SCORED_SQL} SELECT split, regr_slope(y, pred) AS slope, regr_intercept(y, pred) AS intercept,
    regr_r2(y, pred) AS r2, CAST(regr_count(y, pred) AS BIGINT) AS n FROM p GROUP BY 1""",
    ["slope", "intercept", "r2"], digits=6,
)
def _(spark, sf_dir):
    return interpret.fitted_line(scored(spark, sf_dir), "pred", "fq_ret", ["split"])


@ENTRIES.add(
    "i5_residual_distribution",
    f"""WITH {SCORED_SQL}, r AS (SELECT split, y - pred AS residual FROM p), {_hist_sql('r', 'residual', 25, 'split', '')}
    SELECT split, bin, n, lo + bin * width AS "left" FROM h""",
    ["left"], digits=7,
)
def _(spark, sf_dir):
    gap = interpret.residuals(scored(spark, sf_dir), "fq_ret")
    return interpret.histogram(gap, "residual", 25, ["split"], common_over=["split"])


@ENTRIES.add(
    "i6_cross_validation_boxes",
    f"""WITH {CV_SQL}, box AS (SELECT model_id, metric, quantile_cont(value, 0.25) AS q1, median(value) AS q2,
      quantile_cont(value, 0.75) AS q3 FROM cv WHERE partition = 'val' GROUP BY ALL)
    SELECT * FROM box""",
    ["q1", "q2", "q3"], digits=6,
)
def _(spark, sf_dir):
    val = ridge_search(spark, sf_dir).where("partition = 'val'")
    return interpret.box_statistics(val, ["model_id", "metric"], "value").select(
        "model_id", "metric", "q1", "q2", "q3"
    )


@ENTRIES.add(
    "i6_cross_validation_correlation",
    f"""WITH {CV_SQL}, v AS (SELECT * FROM cv WHERE partition = 'val' AND metric IN ('mae', 'mlse', 'Top-Bottom'))
    SELECT a.metric AS x, b.metric AS y, corr(a.value, b.value) AS corr FROM v a JOIN v b USING (model_id, epoch, fold) GROUP BY ALL""",
    ["corr"], digits=5,
)
def _(spark, sf_dir):
    val = ridge_search(spark, sf_dir).where("partition = 'val'")
    names = ["mae", "mlse", "Top-Bottom"]
    wide = val.groupBy("model_id", "epoch", "fold").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]
    )
    return correlation_matrix(wide, names)


LIMITS = [(0.0, 50.0), (0.0, 100.0)]
GRID_SQL = "grid AS (SELECT i * CAST(0.5 AS DOUBLE) AS x1, j * CAST(0.5 AS DOUBLE) AS x2 FROM range(100) a(i), range(200) b(j))"


@ENTRIES.add(
    "i7_decision_surface",
    f"""WITH {SUPPLIERS_SQL}, {ridge_sql('panel', 'fit', 'fq_ret', 1.0)}, {GRID_SQL}
    SELECT x1, x2, intercept + b1 * x1 + b2 * x2 AS pred FROM grid, fit""",
    ["pred"],
)
def _(spark, sf_dir):
    coefs = linear.fit_ridge(supplier_panel(spark, sf_dir), X, "fq_ret", 1.0)
    return interpret.surface(spark, coefs, X, 0.5, LIMITS)


@ENTRIES.add(
    "i8_decision_curve",
    f"""WITH {SUPPLIERS_SQL}, lim AS (SELECT min(x1) AS lo, max(x1) AS hi FROM panel),
    fit AS (SELECT regr_slope(fq_ret, x1) AS b, regr_intercept(fq_ret, x1) AS a FROM panel),
    g AS (SELECT lo + unnest(range(CAST(ceil((hi - lo) / 0.5) AS BIGINT))) * CAST(0.5 AS DOUBLE) AS x1 FROM lim)
    SELECT x1, a + b * x1 AS pred FROM g, fit""",
    ["x1", "pred"], digits=7,
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    coefs = linear.fit_ridge(panel, ["x1"], "fq_ret")
    return interpret.surface(spark, coefs, ["x1"], 0.5, interpret.data_limits(panel, ["x1"]))


@ENTRIES.add(
    "i9_surfaces_of_all_parameter_sets",
    f"WITH {SUPPLIERS_SQL}, "
    + ", ".join(ridge_sql("panel", f"fit{i}", "fq_ret", a) for i, a in enumerate(ALPHAS))
    + f""", fits AS ({' UNION ALL '.join(f'SELECT {i} AS model_id, * FROM fit{i}' for i in range(3))}), {GRID_SQL}
    SELECT model_id, x1, x2, intercept + b1 * x1 + b2 * x2 AS pred FROM grid, fits""",
    ["pred"],
)
def _(spark, sf_dir):
    sums = linear.moments(supplier_panel(spark, sf_dir), X, "fq_ret")
    sets = F.array(*[F.struct(F.lit(i).alias("model_id"), F.lit(a).alias("alpha")) for i, a in enumerate(ALPHAS)])
    fits = linear.solve_ridge(sums.select("*", F.explode(sets).alias("m")).select("*", "m.*"), 2, F.col("alpha"))
    return interpret.surface(spark, fits, X, 0.5, LIMITS, ["model_id"])


@ENTRIES.add(
    "i10_partial_dependence",
    f"""WITH {SUPPLIERS_SQL}, {ridge_sql('panel', 'fit', 'fq_ret', 1.0)},
    g AS (SELECT DISTINCT unnest([{', '.join(f'quantile_cont(x1, {i / 9!r})' for i in range(10))}]) AS g FROM panel),
    p AS (SELECT g, intercept + b1 * g + b2 * x2 AS pred FROM panel, fit, g)
    SELECT g AS x1, avg(pred) AS mean_pred, stddev_pop(pred) AS std_pred FROM p GROUP BY 1""",
    ["x1", "mean_pred", "std_pred"], digits=7,
)
def _(spark, sf_dir):
    panel = supplier_panel(spark, sf_dir)
    coefs = linear.fit_ridge(panel, X, "fq_ret", 1.0)
    return interpret.partial_dependence(
        panel, X, ["x1"], lambda df: linear.predict_linear(df, coefs, X), ["pred"], resolution=10
    )


def _class_score(spark, sf_dir):
    train, _ = class_sides(spark, sf_dir)
    fitted = learners.logistic_one_vs_rest(X, "fq_ret_cls", 3, max_iter=STEPS).fit(train)

    def score(df):
        out = fitted.transform(df)
        return out.withColumns({f"p{i}": F.col("probability")[i] for i in range(3)})

    return train, score


_SIGMOIDS = [f"1 / (1 + exp(-(w{k}.w0 + w{k}.w1 * g1 + w{k}.w2 * g2)))" for k in range(3)]
PAIRS_SQL = f"""{CLASSED_PANEL_SQL}, {rest_sql(None)},
ga AS (SELECT DISTINCT unnest([{', '.join(f'quantile_cont(x1, {i / 5!r})' for i in range(6))}]) AS g1 FROM train),
gb AS (SELECT DISTINCT unnest([{', '.join(f'quantile_cont(x2, {i / 5!r})' for i in range(6))}]) AS g2 FROM train),
raw AS (SELECT g1, g2, {', '.join(f'{p} AS s{k}' for k, p in enumerate(_SIGMOIDS))} FROM train, ga, gb, w0, w1, w2),
dep AS (SELECT g1 AS x1, g2 AS x2, {', '.join(f'avg(s{k} / (s0 + s1 + s2)) AS mean_p{k}' for k in range(3))},
  {', '.join(f'stddev_pop(s{k} / (s0 + s1 + s2)) AS std_p{k}' for k in range(3))} FROM raw GROUP BY ALL)"""
PAIR_COLUMNS = ["x1", "x2", *[f"{m}_p{k}" for m in ("mean", "std") for k in range(3)]]


@ENTRIES.add("i11_partial_dependence_of_pairs", f"WITH {PAIRS_SQL} SELECT * FROM dep", PAIR_COLUMNS, digits=7)
def _(spark, sf_dir):
    train, score = _class_score(spark, sf_dir)
    return interpret.partial_dependence(train, X, X, score, ["p0", "p1", "p2"], resolution=6)


@ENTRIES.add(
    "i12_class_map",
    f"""WITH {PAIRS_SQL} SELECT x1, x2, CASE WHEN mean_p0 >= mean_p1 AND mean_p0 >= mean_p2 THEN 'T3'
    WHEN mean_p1 >= mean_p2 THEN 'T2' ELSE 'T1' END AS label FROM dep""",
    ["x1", "x2"], digits=7,
)
def _(spark, sf_dir):
    train, score = _class_score(spark, sf_dir)
    outputs = ["p0", "p1", "p2"]
    dependence = interpret.partial_dependence(train, X, X, score, outputs, resolution=6)
    return interpret.class_map(dependence, X, outputs, ["T3", "T2", "T1"])


THREE = ("x1", "x2", "n_rows")


def _moved_sql(source, moved, resolution):
    """Every row of ``source`` at every grid point of the ``moved`` factors."""
    grids = ", ".join(
        f"g{i} AS (SELECT DISTINCT unnest([{', '.join(f'quantile_cont({c}, {j / (resolution - 1)!r})' for j in range(resolution))}]) AS v{i} FROM {source})"
        for i, c in enumerate(moved)
    )
    swaps = ", ".join(f"v{moved.index(c)} AS {c}" if c in moved else c for c in THREE)
    marks = ", ".join(f"v{i}" for i in range(len(moved)))
    return f"{grids}, moved AS MATERIALIZED (SELECT row_number() OVER () AS id, {marks}, {swaps} FROM {source}, {', '.join(f'g{i}' for i in range(len(moved)))})"


@ENTRIES.add(
    "i11_tree_dependence",
    f"""WITH {SUPPLIERS_SQL}, {GAPS_SQL}, {trees_sql('gaps', 'fit', 'fq_ret', depth=2, x=THREE, **TREES_SQL)},
    {_moved_sql('gaps', ('x1', 'n_rows'), 6)}, {walk_sql('fit_nodes', 'moved', 'walked', THREE, 2)}
    SELECT v0 AS x1, v1 AS n_rows, avg(score) AS mean_score0 FROM walked JOIN moved USING (id) GROUP BY ALL""",
    ["x1", "n_rows", "mean_score0"],
)
def _(spark, sf_dir):
    panel = with_gaps(supplier_panel(spark, sf_dir))
    model = learners.boosted_trees(THREE, "fq_ret", key=KEY, max_depth=2, **TREES).fit(panel)
    return interpret.tree_dependence(panel, model, ["x1", "n_rows"], 6)


@ENTRIES.add(
    "i12_tree_class_dependence",
    f"""WITH {CLASSED_PANEL_SQL}, {trees_sql('train', 'fit', 'cls', depth=2, x=THREE, n_classes=3, **{**TREES_SQL, 'rounds': 2, 'mcw': 5.0})},
    {_moved_sql('train', ('x2',), 6)}, {walk_sql('fit_nodes', 'moved', 'walked', THREE, 2)},
    e AS (SELECT id, output, exp(score) AS e, sum(exp(score)) OVER (PARTITION BY id) AS s FROM walked),
    m AS (SELECT v0, output, avg(e / s) AS mean, stddev_pop(e / s) AS std FROM e JOIN moved USING (id) GROUP BY ALL)
    SELECT v0 AS x2, {', '.join(f"max({c}) FILTER (output = {k}) AS {c}_p{k}" for c in ('mean', 'std') for k in range(3))} FROM m GROUP BY 1""",
    ["x2", *PAIR_COLUMNS[2:]],
)
def _(spark, sf_dir):
    train, _ = class_sides(spark, sf_dir)
    settings = {**TREES, "n_estimators": 2, "min_child_weight": 5.0}
    model = learners.boosted_classifier(THREE, "fq_ret_cls", 3, key=KEY, max_depth=2, **settings).fit(train)
    return interpret.tree_class_dependence(train, model, ["x2"], 6)


@ENTRIES.add(
    "i13_high_low_error",
    f"WITH {MARKET_SQL} SELECT month, level, (high - low) / 2 AS err FROM market",
    ["level", "err"],
)
def _(spark, sf_dir):
    return market_series(spark, sf_dir).select(
        "month", "level", interpret.half_range(F.col("high"), F.col("low")).alias("err")
    )
