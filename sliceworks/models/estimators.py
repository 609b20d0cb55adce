"""The baseline models as Spark ML estimators.

Where a penalty depends on the number of training rows, a small estimator counts them (and the
spread of the target) when it is fitted and then hands over to Spark's own learner.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.models.prep import classification_prep, regression_prep, release_prep


class _Learner(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def _columns(self) -> dict[str, str]:
        return {"featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol(),
                "predictionCol": self.getPredictionCol()}


class MeanRegressor(_Learner):
    """Predicts the mean of the training target."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        mean = dataset.agg(F.avg(self.getLabelCol())).first()[0]
        return SQLTransformer(statement=(
            f"SELECT *, CAST('{mean!r}' AS DOUBLE) AS {self.getPredictionCol()} FROM __THIS__"))


class Ridge(_Learner):
    """Least squares with an L2 penalty ``alpha`` on the sum of squares, intercept free.

    Spark's normal-equation solver divides the loss by n and measures the target in population
    deviations, so the same objective needs ``alpha * sd(y) / n``.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=1.0, featuresCol="features", labelCol="label",
                 predictionCol="prediction"):
        super().__init__()
        self._setDefault(alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        n, spread = dataset.agg(F.count(F.lit(1)), F.stddev_pop(self.getLabelCol())).first()
        penalty = self.getOrDefault("alpha") * (spread or 1.0) / n
        return LinearRegression(solver="normal", standardization=False, regParam=penalty,
                                **self._columns()).fit(dataset)


def balanced_weights(train: DataFrame, label: str, output: str = "class_weight") -> DataFrame:
    """Weight every row by n / (classes * rows of its class)."""

    counts = {row[0]: row[1] for row in train.groupBy(label).count().collect()}  # one per class
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn(output, weight)


class _Classifier(_Learner):
    balanced = Param(Params._dummy(), "balanced", "weight classes equally", TypeConverters.toBoolean)

    def _weighted(self, dataset: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        if not self.getOrDefault("balanced"):
            return dataset, {}
        return balanced_weights(dataset, self.getLabelCol()), {"weightCol": "class_weight"}


class Logistic(_Classifier):
    """Logistic regression with strength ``c`` (the inverse penalty on the summed loss)."""

    c = Param(Params._dummy(), "c", "inverse penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, c=1.0, maxIter=1000, balanced=False, featuresCol="features",
                 labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(c=1.0, maxIter=1000, balanced=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        weighted, extra = self._weighted(dataset)
        penalty = 1.0 / (self.getOrDefault("c") * dataset.count())
        return LogisticRegression(
            regParam=penalty, elasticNetParam=0.0, standardization=False,
            maxIter=self.getOrDefault("maxIter"), **self._columns(), **extra).fit(weighted)


class Forest(_Classifier):
    """Random forest classifier, square root of the features per split."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth, at most 30", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows per leaf",
                                TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees=200, maxDepth=12, minInstancesPerNode=2, seed=42,
                 balanced=False, featuresCol="features", labelCol="label",
                 predictionCol="prediction"):
        super().__init__()
        self._setDefault(numTrees=200, maxDepth=12, minInstancesPerNode=2, seed=42, balanced=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        weighted, extra = self._weighted(dataset)
        settings = {p: self.getOrDefault(p)
                    for p in ("numTrees", "maxDepth", "minInstancesPerNode", "seed")}
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **settings, **self._columns(),
                                      **extra).fit(weighted)


class DummyClassifier(_Learner):
    """Ignores the features: ``most_frequent``, ``prior``, ``stratified`` or ``uniform``.

    The random strategies draw from a hash of the row's id, so a row always gets the same guess.
    """

    strategy = Param(Params._dummy(), "strategy", "strategy", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "row id, for the random ones", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, strategy="most_frequent", seed=42, idCol="", featuresCol="features",
                 labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(strategy="most_frequent", seed=42, idCol="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        counts = sorted((row[0], row[1]) for row in
                        dataset.groupBy(self.getLabelCol()).count().collect())  # one per class
        total = sum(n for _, n in counts)
        strategy, top = self.getOrDefault("strategy"), max(counts, key=lambda x: (x[1], -x[0]))[0]
        size = int(counts[-1][0]) + 1
        shares = [0.0] * size
        for value, n in counts:
            if strategy in ("prior", "stratified"):
                shares[int(value)] = n / total
            elif strategy == "uniform":
                shares[int(value)] = 1.0 / len(counts)
        if strategy == "most_frequent":
            shares[int(top)] = 1.0
        guess = f"CAST({float(top)!r} AS DOUBLE)"
        if strategy in ("stratified", "uniform"):
            identity = self.getOrDefault("idCol")
            if not identity:
                raise ValueError("The random strategies need idCol.")
            draw = (f"(pmod(xxhash64('{self.getOrDefault('seed')}', `{identity}`), 1000000007) "
                    "/ 1000000007D)")
            steps, upto = [], 0.0
            for i, share in enumerate(shares[:-1]):
                upto += share
                steps.append(f"WHEN {draw} < CAST('{upto!r}' AS DOUBLE) THEN {float(i)!r}D")
            guess = f"CASE {' '.join(steps)} ELSE {float(size - 1)!r}D END" if steps else "0.0D"
        scores = ", ".join(f"CAST('{s!r}' AS DOUBLE)" for s in shares)
        return SQLTransformer(statement=(
            f"SELECT *, array({scores}) AS scores, {guess} AS {self.getPredictionCol()} "
            "FROM __THIS__"))


def boosted_classifier(classes: int, *, maxIter=300, maxDepth=6, stepSize=0.05,
                       subsamplingRate=0.8, seed=42, labelCol="label"):
    """Boosted trees: Spark's own for two classes, one against the rest beyond."""

    trees = GBTClassifier(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, seed=seed,
                          subsamplingRate=subsamplingRate, labelCol=labelCol)
    return trees if classes == 2 else OneVsRest(classifier=trees, labelCol=labelCol)


def forest_regressor(*, numTrees=200, maxDepth=12, minInstancesPerNode=2, seed=42, labelCol="label"):
    """Random forest regressor: all features at every split."""

    return RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth, seed=seed, labelCol=labelCol,
                                 minInstancesPerNode=minInstancesPerNode,
                                 featureSubsetStrategy="all")


def boosted_regressor(*, maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, seed=42,
                      labelCol="label"):
    """Boosted trees with squared loss."""

    return GBTRegressor(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, seed=seed,
                        subsamplingRate=subsamplingRate, labelCol=labelCol)


@dataclass(frozen=True)
class ModelSpec:
    """A named model: how to build it, which preparation it takes and the settings to try."""

    name: str
    build: Callable[[], Estimator]
    grid: Sequence[dict[str, object]] = ({},)

    def pipeline(self, prep: Estimator) -> Pipeline:
        return Pipeline(stages=[prep, self.build()])


def release_models(label: str = "label", trees: int = 200, rounds: int = 300) -> list[ModelSpec]:
    """The regime study's models with the settings each is tuned over."""

    return [
        ModelSpec("dummy_mean", lambda: MeanRegressor(labelCol=label)),
        ModelSpec("ridge_regression", lambda: Ridge(labelCol=label),
                  [{"alpha": a} for a in (0.1, 1.0, 10.0)]),
        ModelSpec("random_forest_regressor",
                  lambda: forest_regressor(numTrees=trees, labelCol=label),
                  [{"maxDepth": d, "minInstancesPerNode": leaf}
                   for d in (8, 12, 30) for leaf in (1, 2)]),
        ModelSpec("boosted_regressor", lambda: boosted_regressor(maxIter=rounds, labelCol=label),
                  [{"maxDepth": d, "stepSize": s} for s in (0.05, 0.1) for d in (4, 6)]),
    ]


def suite_regressors(label: str = "label", trees: int = 200, rounds: int = 300) -> list[ModelSpec]:
    """The plain regression suite: mean, forest, boosted trees."""

    return [
        ModelSpec("dummy_regressor", lambda: MeanRegressor(labelCol=label)),
        ModelSpec("random_forest_regressor",
                  lambda: forest_regressor(numTrees=trees, labelCol=label)),
        ModelSpec("boosted_regressor", lambda: boosted_regressor(maxIter=rounds, labelCol=label)),
    ]


def suite_classifiers(classes: int, trees: int = 200, rounds: int = 300) -> list[ModelSpec]:
    """The classifier suite: majority, logistic, forest, boosted trees."""

    return [
        ModelSpec("dummy_most_frequent", lambda: DummyClassifier()),
        ModelSpec("logistic_regression", lambda: Logistic()),
        ModelSpec("random_forest", lambda: Forest(numTrees=trees)),
        ModelSpec("boosted_trees", lambda: boosted_classifier(classes, maxIter=rounds)),
    ]


def tuning_classifiers(classes: int, trees: Sequence[int] = (200, 400)) -> list[ModelSpec]:
    """The two tuned classifiers with every setting tried, in order.

    Spark's forest has no minimum split size, so its grid is the depth, leaf and tree counts.
    """

    return [
        ModelSpec("random_forest", lambda: Forest(),
                  [{"maxDepth": d, "minInstancesPerNode": leaf, "numTrees": n}
                   for d in (8, 12, 30) for leaf in (1, 2) for n in trees]),
        ModelSpec("boosted_trees", lambda: boosted_classifier(classes),
                  [{"stepSize": s, "maxDepth": d, "maxIter": n}
                   for s in (0.03, 0.05, 0.1) for d in (4, 6, 8) for n in trees]),
    ]


PREPARATIONS = {"classification": classification_prep, "regression": regression_prep,
                "release": release_prep}
