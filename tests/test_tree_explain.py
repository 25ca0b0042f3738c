"""Exact tree explanations against the enumeration of all feature subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from loomwork.operators.boosting import HistogramBoosting
from loomwork.operators.tree_explain import exact_shapley_values, model_leaves

NAMES = ["a", "b", "c", "d"]


def by_subsets(leaves, x, background):
    """Shapley values of the mean score over the background, from its value on every subset."""
    score = lambda rows: sum(leaf.value * np.all([c.holds(rows[:, f]) for f, c in leaf.path] or [np.ones(len(rows), bool)], axis=0) for leaf in leaves)
    n = len(x)
    value = {}
    for k in range(n + 1):
        for s in itertools.combinations(range(n), k):
            mixed = background.copy()
            mixed[:, list(s)] = x[list(s)]
            value[s] = score(mixed).mean()
    phi = np.zeros(n)
    for s, v in value.items():
        for i in set(range(n)) - set(s):
            phi[i] += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[tuple(sorted((*s, i)))] - v)
    return phi


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 4)), 1)
    y = x[:, 0] * (x[:, 1] > 0) + 2 * (x[:, 2] > x[:, 3])
    df = spark.createDataFrame([(i, *map(float, v), float(t), float(t > 0.5)) for i, (v, t) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, label double, bit double").repartition(3)
    return x, VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def fitted(df, kind):
    if kind == "tree":
        return DecisionTreeRegressor(maxDepth=4).fit(df), F.col("prediction")
    if kind == "gbt":
        return GBTRegressor(maxDepth=3, maxIter=4).fit(df), F.col("prediction")
    if kind == "forest":
        return RandomForestClassifier(labelCol="bit", numTrees=5, maxDepth=3).fit(df), vector_to_array("probability")[1]
    return HistogramBoosting(maxDepth=3, maxIter=4, stepSize=0.5).fit(df), F.col("prediction")


@pytest.mark.parametrize("kind", ["tree", "gbt", "forest", "boosted"])
def test_equals_all_subsets(rows, kind):
    x, df = rows
    model, score = fitted(df, kind)
    leaves = model_leaves(model)
    asked = df.where("id < 25")
    got = exact_shapley_values(leaves, asked, df, NAMES, ["id"]).collect()
    table = {(r["id"], r["feature"]): r["phi"] for r in got}
    assert len(got) == len(table) == 100
    for i in range(25):
        assert [table[i, f] for f in NAMES] == pytest.approx(list(by_subsets(leaves, x[i], x)), abs=1e-9)
    scores = {r["id"]: r["s"] for r in model.transform(df).select("id", score.alias("s")).collect()}
    mean = np.mean(list(scores.values()))
    for i in range(25):
        assert sum(table[i, f] for f in NAMES) == pytest.approx(scores[i] - mean, abs=1e-9)


def test_missing_values_and_odd_tables(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(80, 2)), 1)
    x[rng.random((80, 2)) < 0.3] = np.nan
    y = np.where(np.isnan(x[:, 0]), 5.0, x[:, 0]) + (x[:, 1] > 0)
    df = spark.createDataFrame([(i % 60 or None, *[None if np.isnan(a) else float(a) for a in v], float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    vector = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(df)
    leaves = model_leaves(HistogramBoosting(maxDepth=3, maxIter=3, stepSize=0.5).fit(vector))
    got = exact_shapley_values(leaves, df, df, ["a", "b"], ["id"])
    assert got.count() == 160
    found = {(r["id"], r["feature"]): r["phi"] for r in got.where("id between 30 and 59").collect()}
    for i in range(30, 60):
        assert [found[i, f] for f in "ab"] == pytest.approx(list(by_subsets(leaves, x[i], x)), abs=1e-9)
    assert exact_shapley_values(leaves, df.limit(0), df, ["a", "b"], ["id"]).collect() == []
    with pytest.raises(ValueError):
        exact_shapley_values(leaves, df, df.limit(0), ["a", "b"], ["id"])
    with pytest.raises(TypeError):
        model_leaves(VectorAssembler(inputCols=["a"], outputCol="x"))
