"""Model registry: names, estimators and default parameters."""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import SparkSession

from loomwork.operators.boosting import HistogramBoosting
from loomwork.operators.cells import CellBoostingClassifier, CellBoostingRegressor, forest_trees
from loomwork.operators.factorization import FactorizationMachine
from loomwork.operators.mixture import RegularisedMixture
from loomwork.session import spread

SEED = 42


class SpreadForest(RandomForestRegressor):
    """Many rows that share cells are fitted as cells. Else Spark keeps a count per tree beside every row, so the rows of a task are bounded."""

    def _fit(self, dataset):
        rows = dataset.select(self.getLabelCol(), self.getFeaturesCol())
        trees = forest_trees(self, rows)
        return super()._fit(spread(rows)) if trees is None else self._of_trees(trees)

    def _of_trees(self, trees: list) -> RandomForestRegressionModel:
        spark = SparkSession.active()
        names = spark.sparkContext._jvm.org.apache.spark.ml.regression
        held = spark.sparkContext._gateway.new_array(names.DecisionTreeRegressionModel, len(trees))
        for i, tree in enumerate(trees):
            held[i] = tree._java_obj
        model = names.RandomForestRegressionModel(self.uid, held, trees[0].numFeatures)
        model = self._copyValues(RandomForestRegressionModel(model))
        model._transfer_params_to_java()
        return model


# Default parameters of every model.
CLASSIFIERS = {
    "logistic": (LogisticRegression, {"maxIter": 10, "regParam": 0.0, "elasticNetParam": 0.0}),
    "random_forest": (RandomForestClassifier, {"numTrees": 10, "maxDepth": 5, "maxBins": 32, "seed": SEED}),
    "gradient_boosting": (CellBoostingClassifier, {"maxIter": 50, "maxDepth": 5, "maxBins": 64, "stepSize": 0.1, "seed": SEED}),
    "decision_tree": (DecisionTreeClassifier, {"maxDepth": 5, "maxBins": 32, "seed": SEED}),
    "neural_network": (MultilayerPerceptronClassifier, {"maxIter": 100, "blockSize": 512, "seed": SEED}),
    "histogram_boosting": (HistogramBoosting, {"maxIter": 50, "maxDepth": 5, "maxBins": 64, "stepSize": 0.1}),
}
REGRESSORS = {
    "linear_regression": (LinearRegression, {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.0}),
    "random_forest": (SpreadForest, {"numTrees": 100, "maxDepth": 5, "maxBins": 256, "seed": SEED}),
    "gradient_boosting": (CellBoostingRegressor, {"maxIter": 50, "maxDepth": 5, "maxBins": 64, "stepSize": 0.1, "seed": SEED}),
    "decision_tree": (DecisionTreeRegressor, {"maxDepth": 5, "maxBins": 256, "seed": SEED}),
    "factorization_machine": (FactorizationMachine, {"factorSize": 8, "seed": SEED}),
    "histogram_boosting": (HistogramBoosting, {"maxIter": 50, "maxDepth": 5, "maxBins": 64, "stepSize": 0.1}),
}
CLUSTERERS = {
    "kmeans": (KMeans, {"k": 3, "maxIter": 20, "tol": 1e-4, "initMode": "k-means||", "seed": SEED}),
    "bisecting_kmeans": (BisectingKMeans, {"k": 3, "maxIter": 20, "minDivisibleClusterSize": 1.0, "seed": SEED}),
    "gaussian_mixture": (GaussianMixture, {"k": 3, "maxIter": 100, "tol": 1e-4, "seed": SEED}),
    "regularised_mixture": (RegularisedMixture, {"k": 3, "maxIter": 100, "tol": 1e-4, "regParam": 0.01, "seed": SEED}),
}
REGISTRY = {"classification": CLASSIFIERS, "regression": REGRESSORS, "clustering": CLUSTERERS}
BINARY_ONLY = {"gradient_boosting"}

# Hidden layer width of the neural network by number of features.
HIDDEN_SMALL, HIDDEN_MEDIUM, HIDDEN_LARGE = (10, 8), (20, 16), 32


def hidden_width(features: int) -> int:
    for most, width in (HIDDEN_SMALL, HIDDEN_MEDIUM):
        if features <= most:
            return width
    return HIDDEN_LARGE


def estimator(kind: str, name: str, params: dict | None = None, *, features: int | None = None,
              classes: int = 2):
    """An unfitted estimator with defaults overridden by ``params``.

    For the neural network ``layers`` lists hidden widths only; input and output widths are added here.
    """
    if name not in REGISTRY[kind]:
        raise ValueError(f"unknown {kind} model {name!r}; known: {sorted(REGISTRY[kind])}")
    cls, defaults = REGISTRY[kind][name]
    chosen = {**defaults, **(params or {})}
    if name == "neural_network":
        if features is None:
            raise ValueError("the neural network needs the number of features")
        hidden = chosen.pop("layers", None) or [hidden_width(features)]
        chosen["layers"] = [features, *hidden, classes]
    if name == "histogram_boosting" and kind == "classification":
        chosen |= {"objective": "logistic" if classes <= 2 else "softmax", "classes": classes}
    if kind != "clustering":
        chosen["labelCol"] = "label"
    return cls(featuresCol="features", **chosen)


def available_models(kind: str, classes: int = 2) -> list[str]:
    """Models that a run fits when none are named; for more than two classes histogram boosting takes the place of the binary-only one."""
    names = [n for n in REGISTRY[kind] if n not in ("factorization_machine", "histogram_boosting")]
    return names if classes <= 2 else [n for n in names if n not in BINARY_ONLY] + ["histogram_boosting"]
