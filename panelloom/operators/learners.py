"""Models behind one calling convention, prediction and walk-forward."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table
from . import logistic as newton, trees
from .kernel import PolynomialSVC
from .logistic import Logistic
from .splits import train_test_split_by_date
from .trees import BoostedTrees, TreeModel, TreeParams


def _assemble(features: Sequence[str], output: str = "_features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep")


class WholeRows:
    """Fits a Spark ML estimator on rows that have all factors and scores every row.

    A row without a factor stays and has no prediction.
    """

    def __init__(self, estimator: Estimator, features: Sequence[str], label: str):
        self.estimator, self.features, self.label = estimator, list(features), label

    def fit(self, df: DataFrame) -> "WholeModel":
        whole = df.where(has_all([*self.features, self.label]))
        return WholeModel(self.estimator.fit(whole), self.features)


class WholeModel:
    def __init__(self, model: Model, features: Sequence[str]):
        self.model, self.features = model, list(features)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return scored.withColumn("pred", F.when(has_all(self.features), F.col("pred")))


def has_all(columns: Sequence[str]) -> Column:
    """Neither null nor NaN in any of the columns."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def _finish(drop: Sequence[str] = ("_features",)) -> SQLTransformer:
    """Name the prediction ``pred`` and drop the model's own vector columns."""
    gone = ", ".join(drop)
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}) FROM __THIS__")


def linear_regression(
    features, label, alpha=0.0, n_rows=1, label_std=1.0, fit_intercept=True
) -> WholeRows:
    """Ridge with an absolute penalty ``alpha``.

    Spark penalises per row and in units of the label's deviation, so both are needed
    to state the same penalty.
    """
    model = LinearRegression(
        featuresCol="_features", labelCol=label, predictionCol="pred",
        regParam=alpha * label_std / n_rows,
        standardization=False, fitIntercept=fit_intercept, solver="normal",
    )
    return WholeRows(Pipeline(stages=[_assemble(features), model, _finish()]), features, label)


def boosted_trees(features, label, objective="mse", n_classes=1, key=(), **params) -> BoostedTrees:
    """Histogram trees by the reference's parameter names: n_estimators, eta (learning_rate),
    max_depth, min_child_weight, gamma, reg_lambda, subsample, and max_bins, start, seed."""
    names = {"n_estimators": "rounds", "learning_rate": "eta"}
    own = {names.get(k, k): v for k, v in params.items()}
    return BoostedTrees(features, label, TreeParams(objective, n_classes=n_classes, **own), key)


def boosted_classifier(features, label, n_classes, key=(), **params) -> BoostedTrees:
    """One tree per class and round on the softmax loss."""
    return boosted_trees(features, label, "softmax", n_classes, key, **params)


def logistic_one_vs_rest(features, label, n_classes=None, c: float | None = None, **rest) -> Logistic:
    return Logistic(features, label, n_classes, c, "ovr", **rest)


def logistic(features, label, n_classes=None, c: float | None = None, **rest) -> Logistic:
    """Multinomial, with the penalty ``|w|^2 / (2 c)`` on the summed loss, or none."""
    return Logistic(features, label, n_classes, c, "multinomial", **rest)


def polynomial_svc(features, label, n_classes, degree=3, c=1.0, gamma=None, coef0=0.0) -> PolynomialSVC:
    """Support vectors with a polynomial kernel, one class against one."""
    return PolynomialSVC(features, label, n_classes, degree, c, gamma, coef0)


def net(features, label, layers, seed, max_iter=50) -> WholeRows:
    """One small dense net with softmax outputs."""
    model = MultilayerPerceptronClassifier(
        featuresCol="_features", labelCol=label, predictionCol="pred", layers=list(layers), seed=seed,
        maxIter=max_iter, probabilityCol="_probability", rawPredictionCol="_raw",
    )
    stages = [
        _assemble(features, "_raw_features"),
        StandardScaler(inputCol="_raw_features", outputCol="_features", withMean=True),
        model,
        _finish(("_features", "_raw_features", "_raw")),
    ]
    return WholeRows(Pipeline(stages=stages), features, label)


class NetEnsemble:
    """Several seeded nets: class probabilities are averaged, the largest one wins."""

    def __init__(self, features, label, layers, n_nets=3, max_iter=50):
        self.features = list(features)
        self.parts = [net(features, label, layers, seed, max_iter) for seed in range(n_nets)]
        self.models: list[WholeModel] = []

    def fit(self, df: DataFrame) -> "NetEnsemble":
        self.models = [p.fit(df) for p in self.parts]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, model in enumerate(self.models):
            scored = model.transform(out)
            out = scored.withColumn(f"_p{i}", vector_to_array("_probability"))
            out = out.drop("_probability", "pred")
        whole = F.lit(float(len(self.models)))
        mean = F.col("_p0")
        for i in range(1, len(self.models)):
            mean = F.zip_with(mean, F.col(f"_p{i}"), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform(mean, lambda v: v / whole))
        best = F.when(has_all(self.features), F.array_position("probability", F.array_max("probability")) - 1)
        return out.withColumn("pred", best.cast("double")).drop(*[f"_p{i}" for i in range(len(self.models))])


def class_probabilities(scored: DataFrame) -> DataFrame:
    """``probability`` as an array of class scores."""
    if "_probability" not in scored.columns:
        return scored
    return scored.withColumn("probability", vector_to_array("_probability")).drop("_probability")


def predict(
    model: Estimator,
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    date: str | None = None,
    expand_window: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of both sides, with the wanted columns beside ``pred``.

    With ``expand_window`` every test month is scored by a model trained on everything
    before it; the train side is then scored by the last of these models, that is on
    all months but the last.
    """
    columns = list(columns)
    if not expand_window:
        fitted = model.fit(train)
        return tuple(fitted.transform(d).select(*columns, "pred") for d in (train, test))
    if isinstance(model, (BoostedTrees, Logistic)):
        return _walk_together(model, train, test, columns, date)
    # The test months are a calendar of few entries.
    months = [r[0] for r in test.select(date).distinct().orderBy(date).collect()]
    parts = []
    for month in months:
        grown = train.unionByName(test.where(F.col(date) < F.lit(month)))
        fitted = model.fit(grown)
        now = test.where(F.col(date) == F.lit(month))
        parts.append(fitted.transform(now).select(*columns, "pred"))
    return fitted.transform(grown).select(*columns, "pred"), reduce(DataFrame.unionByName, parts)


# The date of rows that every model of a walk-forward learns from.
ALWAYS = -(2**31)


def day_number(day: dt.date) -> int:
    """Days since 1970, as ``unix_date`` counts them."""
    return (day - dt.date(1970, 1, 1)).days


def _walk_together(model, train, test, columns, date) -> tuple[DataFrame, DataFrame]:
    """The same with all months' models fitted in the same passes over the panel.

    Every model has the train rows and the test rows before its month. Cuts of factors are
    those of the train rows, which no model may look beyond. The panel is written once; the
    calendar, the cuts, the fit and the predictions read it.
    """
    names = list(dict.fromkeys([*columns, *model.features, model.label, *getattr(model, "key", ()), date]))
    both = train.select(*names, F.lit(ALWAYS).alias("_when")).unionByName(
        test.select(*names, F.unix_date(date).alias("_when"))
    )
    both, _ = write_table(both, "walk")
    trained = F.col("_when").eqNullSafe(F.lit(ALWAYS))
    train, test = both.where(trained).drop("_when"), both.where(~trained).drop("_when")
    # The test months are a calendar of few entries.
    months = [r[0] for r in test.select(date).distinct().orderBy(date).collect()]
    numbers = [day_number(m) for m in months]
    sets = [frozenset([ALWAYS, *[n for n in numbers if n < now]]) for now in numbers]
    together = {"when": F.col("_when")}
    if isinstance(model, BoostedTrees):
        fits = trees.fit_together(both, [model] * len(sets), sets, cuts_from=F.col("_when") == ALWAYS, **together)
        at = F.array_position(F.array(*[F.lit(n) for n in numbers]), F.unix_date(date)) - 1
        out = test.withColumn("pred", trees.prediction_of(fits, model.features, at))
    else:
        fits = newton.fit_together(both, [model] * len(sets), sets, **together)
        pred = F.lit(None).cast("double")
        for n, fitted in zip(numbers, fits):
            pred = F.when(F.unix_date(date) == n, fitted.pred_column()).otherwise(pred)
        out = test.withColumn("pred", pred)
    grown = train.select(*names).unionByName(test.where(F.col(date) < F.lit(months[-1])).select(*names))
    return fits[-1].transform(grown).select(*columns, "pred"), out.select(*columns, "pred")


def sweep_test_periods(
    df: DataFrame,
    date: str,
    periods: Iterable[tuple[str, str, str]],
    study: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Repeat a whole study for every (name, begin, end) test window."""
    parts = []
    for name, begin, end in periods:
        train, test = train_test_split_by_date(df, date, begin, end)
        parts.append(study(train, test).withColumn("test_period", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def save_model(model: Model | TreeModel, path: str, spark: SparkSession | None = None) -> None:
    """Spark's own models by their writer, trees as a table of nodes."""
    if isinstance(model, TreeModel):
        model.save(spark or SparkSession.getActiveSession(), path)
    else:
        model = model.model if isinstance(model, WholeModel) else model
        model.write().overwrite().save(path)


def load_model(path: str) -> WholeModel | TreeModel:
    """A stored model; its ``metadata`` tells of which kind. Rows without a factor are scored
    by trees and get a null from other models."""
    spark = SparkSession.getActiveSession()
    about = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()[0])
    if about["class"] == trees.CLASS_NAME:
        return trees.load_trees(spark, path, about)
    model = PipelineModel.load(path)
    inputs = [c for s in model.stages if s.hasParam("inputCols") and s.isDefined("inputCols") for c in s.getInputCols()]
    return WholeModel(model, inputs)
