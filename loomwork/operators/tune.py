"""Parameter search and cross-validation with pyspark.ml fits; only scores come back to the driver."""

from __future__ import annotations

import itertools
import json
import math
import random
import statistics
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import (BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.clustering_metrics import all_indices
from loomwork.operators.models import estimator
from loomwork.operators.split import assign_fold
from loomwork.session import stage

# Parameter values tried for every model. Lists are choices, pairs are ranges.
SPACES = {
    "classification": {
        "logistic": {"maxIter": [10, 20, 50, 100], "regParam": [0.01, 0.1, 0.5, 1.0],
                     "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0]},
        "random_forest": {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
        "decision_tree": {"maxDepth": [3, 5], "minInstancesPerNode": [1, 2], "minInfoGain": [0.0, 0.01]},
        "gradient_boosting": {"maxIter": [5, 10], "maxDepth": [3, 5], "stepSize": [0.1]},
        "neural_network": {"layers": [[8], [16], [8, 4], [16, 8], [16, 8, 4]], "maxIter": [50, 100, 200],
                           "blockSize": [32, 64, 128]},
        "histogram_boosting": {"maxIter": [5, 10, 20], "maxDepth": [3, 5], "stepSize": [0.1, 0.3], "regLambda": [1.0, 10.0]},
    },
    "regression": {
        "linear_regression": {"regParam": (0.001, 1.0), "elasticNetParam": (0.0, 1.0)},
        "random_forest": {"numTrees": (5, 10), "maxDepth": (3, 5), "minInstancesPerNode": (1, 2),
                          "subsamplingRate": (0.8, 1.0), "maxBins": (32, 64)},
        "gradient_boosting": {"maxIter": (5, 10), "maxDepth": (3, 5), "stepSize": [0.1],
                              "subsamplingRate": (0.8, 1.0), "maxBins": (32, 64)},
        "decision_tree": {"maxDepth": (3, 5), "minInstancesPerNode": (1, 2), "minInfoGain": (0.0, 0.01),
                          "maxBins": (32, 64)},
        "histogram_boosting": {"maxIter": (5, 20), "maxDepth": (3, 5), "stepSize": (0.1, 0.3), "regLambda": (1.0, 10.0)},
    },
    "clustering": {
        "kmeans": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": (10, 100), "tol": (1e-6, 1e-2),
                   "initMode": ["k-means||", "random"]},
        "bisecting_kmeans": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": (10, 100),
                             "minDivisibleClusterSize": (0.5, 5.0)},
        "gaussian_mixture": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": (50, 300), "tol": (1e-6, 1e-3)},
        "regularised_mixture": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": (50, 300), "tol": (1e-6, 1e-3), "regParam": [0.001, 0.01, 0.1]},
    },
}
GRIDS = {
    "classification": SPACES["classification"],
    "regression": {
        "linear_regression": {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
        "random_forest": {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
        "gradient_boosting": {"maxIter": [5, 10], "maxDepth": [3, 5], "stepSize": [0.1], "maxBins": [32, 64]},
        "decision_tree": {"maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
        "histogram_boosting": {"maxIter": [5, 10, 20], "maxDepth": [3, 5], "stepSize": [0.1, 0.3]},
    },
    "clustering": {
        "kmeans": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [20, 50, 100], "initMode": ["k-means||", "random"]},
        "bisecting_kmeans": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [20, 50, 100],
                             "minDivisibleClusterSize": [1.0, 2.0, 3.0]},
        "gaussian_mixture": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [50, 100, 200], "tol": [1e-5, 1e-4, 1e-3]},
        "regularised_mixture": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [100], "tol": [1e-4], "regParam": [0.001, 0.01, 0.1]},
    },
}


def evaluator_for(kind: str, metric: str | None = None, classes: int = 2):
    """The Spark evaluator of a metric; defaults are roc / accuracy / rmse / silhouette."""
    if kind == "clustering":
        return ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    if kind == "regression":
        return RegressionEvaluator(labelCol="label", metricName=metric or "rmse")
    metric = metric or ("roc" if classes <= 2 else "accuracy")
    if metric in ("roc", "pr"):
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0,
                                             metricName="areaUnderROC" if metric == "roc" else "areaUnderPR")
    names = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
    return MulticlassClassificationEvaluator(labelCol="label", metricName=names[metric])


def draw_params(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct random parameter sets, or all of a smaller space; ranges are drawn uniformly in the type of their ends."""
    rng, seen, out = random.Random(seed), set(), []
    whole = {name: list(range(v[0], v[1] + 1)) if isinstance(v, tuple) and all(isinstance(x, int) for x in v) else v for name, v in space.items()}
    if all(isinstance(v, list) for v in whole.values()):
        total = math.prod(len(v) for v in whole.values())
        for index in rng.sample(range(total), min(n, total)):
            params = {}
            for name, values in whole.items():
                index, at = divmod(index, len(values))
                params[name] = values[at]
            out.append(params)
        return out

    def one(values):
        if isinstance(values, tuple):
            low, high = values
            return rng.randint(low, high) if isinstance(low, int) and isinstance(high, int) else rng.uniform(low, high)
        return rng.choice(values)

    while len(out) < n:
        params = {name: one(values) for name, values in space.items()}
        text = json.dumps(params, sort_keys=True)
        if text not in seen:
            seen.add(text)
            out.append(params)
    return out


def grid_params(space: dict) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def scorer(kind: str, name: str, train: DataFrame, valid: DataFrame | None = None, *, metric: str | None = None, features: int | None = None,
           classes: int = 2, keys: list[str] | None = None, folds: int = 3,
           balance: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Callable[..., float], bool]:
    """(score, larger is better): ``score(params, narrow)`` fits on train, cut by ``narrow`` if given, and judges all held-out rows."""
    ev = evaluator_for(kind, metric, classes)

    def whole(df: DataFrame) -> DataFrame:
        return df

    if kind != "clustering" and valid is None:
        parts = fold_parts(train, keys, folds, balance)

        def score(params: dict, narrow: Callable[[DataFrame], DataFrame] = whole) -> float:
            return _fold_scores(estimator(kind, name, params, features=features, classes=classes), [(narrow(f), j) for f, j in parts], ev)[0]
    else:
        judged = train if valid is None else valid

        def score(params: dict, narrow: Callable[[DataFrame], DataFrame] = whole) -> float:
            model = estimator(kind, name, params, features=features, classes=classes).fit(narrow(train))
            predictions = model.transform(judged)
            if kind == "clustering" and predictions.select("prediction").distinct().limit(2).count() < 2:
                return -1.0
            return float(ev.evaluate(predictions))

    return score, ev.isLargerBetter()


def search(kind: str, name: str, train: DataFrame, valid: DataFrame | None = None, *, trials: list[dict],
           metric: str | None = None, features: int | None = None, classes: int = 2, keys: list[str] | None = None,
           folds: int = 3, parallelism: int = 4, balance: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(trial, params, score, best): every parameter set fitted on train and scored on held-out rows.

    Held-out rows are ``valid``, else key-hash folds of train, whose training rows ``balance`` may change. Clusterings have
    no label to leak and are scored on the rows they were fitted on.
    """
    score, larger = scorer(kind, name, train, valid, metric=metric, features=features, classes=classes, keys=keys, folds=folds, balance=balance)
    with ThreadPool(min(parallelism, max(1, len(trials)))) as pool:
        scores = pool.map(score, trials)
    best = (max if larger else min)(range(len(trials)), key=lambda i: scores[i]) if trials else -1
    rows = [(i, json.dumps(p, sort_keys=True), scores[i], i == best) for i, p in enumerate(trials)]
    return train.sparkSession.createDataFrame(rows, "trial int, params string, score double, best boolean")


def random_search(kind: str, name: str, train: DataFrame, valid: DataFrame | None = None, *, n: int = 10,
                  seed: int = 42, space: dict | None = None, **options) -> DataFrame:
    trials = draw_params(space or SPACES[kind][name], n, seed)
    return search(kind, name, train, valid, trials=trials, **options)


def grid_search(kind: str, name: str, train: DataFrame, valid: DataFrame | None = None, *, n: int = 10,
                seed: int = 42, space: dict | None = None, **options) -> DataFrame:
    """All combinations, however many; ``n`` and ``seed`` belong to ``random_search``, which tries fewer."""
    return search(kind, name, train, valid, trials=grid_params(space or GRIDS[kind][name]), **options)


def best_params(results: DataFrame) -> dict:
    return json.loads(results.where("best").first()["params"])


def fold_parts(df: DataFrame, keys: list[str], folds: int, balance: Callable[[DataFrame], DataFrame] | None = None,
               columns: list[str] | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """(rows to fit, rows to judge) of every key-hash fold, with the given or all columns.

    ``balance`` changes the rows to fit of each fold by themselves, so no copy or mixture of a judged row is ever fitted; the
    judged rows stay as they are.
    """
    tagged = stage(assign_fold(df, keys, folds).select(*(columns or df.columns), "fold"), "folds")
    parts = [(tagged.where(F.col("fold") != f).drop("fold"), tagged.where(F.col("fold") == f).drop("fold")) for f in range(folds)]
    return parts if balance is None else [(stage(balance(fitted), "balanced"), judged) for fitted, judged in parts]


def _fold_scores(est, parts: list[tuple[DataFrame, DataFrame]], ev) -> tuple[float, float]:
    scores = [float(ev.evaluate(est.fit(fitted).transform(judged))) for fitted, judged in parts]
    return statistics.fmean(scores), statistics.pstdev(scores)


def cross_validate(kind: str, name: str, df: DataFrame, keys: list[str], *, params: dict | None = None, folds: int = 5,
                   metric: str | None = None, features: int | None = None, classes: int = 2,
                   balance: Callable[[DataFrame], DataFrame] | None = None, parts: list[tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """(folds, mean, std) of the metric over key-hash folds of un-balanced rows.

    ``balance`` sees the rows to fit of a fold only; ``parts`` are folds made before, for several models.
    """
    parts = parts or fold_parts(df, keys, folds, balance, ["label", "features"] if balance is None else None)
    mean, std = _fold_scores(estimator(kind, name, params, features=features, classes=classes), parts, evaluator_for(kind, metric, classes))
    return df.sparkSession.createDataFrame([(len(parts), mean, std)], "folds int, mean double, std double")


def sweep_k(name: str, df: DataFrame, ks: list[int], params: dict | None = None) -> tuple[DataFrame, dict]:
    """Fit every k; (k, inertia, silhouette, calinski_harabasz, davies_bouldin, num_clusters) and the models."""
    models, parts = {}, None
    for k in ks:
        models[k] = estimator("clustering", name, {**(params or {}), "k": k}).fit(df)
        row = all_indices(models[k].transform(df)).select(
            F.lit(k).alias("k"), "inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "num_clusters")
        parts = row if parts is None else parts.unionByName(row)
    return stage(parts, "sweep"), models


def cross_validate_clusters(name: str, df: DataFrame, keys: list[str], params: dict | None = None,
                            folds: int = 5) -> DataFrame:
    """(metric, mean, std, min, max) of held-out clustering indices over key-hash folds."""
    tagged, parts = stage(assign_fold(df, keys, folds), "folds"), None
    for f in range(folds):
        model = estimator("clustering", name, params).fit(tagged.where(F.col("fold") != f))
        row = all_indices(model.transform(tagged.where(F.col("fold") == f))).select(
            F.lit(f).alias("fold"), "silhouette", "inertia", "calinski_harabasz", "davies_bouldin")
        parts = row if parts is None else parts.unionByName(row)
    long = parts.unpivot(["fold"], ["silhouette", "inertia", "calinski_harabasz", "davies_bouldin"], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.min("value").alias("min"), F.max("value").alias("max"))
