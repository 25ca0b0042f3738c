"""Boosters and importances fitted on rows summed up in cells: same trees as on the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from loomwork.operators import cells as ce
from loomwork.operators import features as fs
from loomwork.operators.models import estimator


def _counted(rows, by):
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, 4000), rng.integers(0, 5, 4000) / 10, rng.integers(0, 3, 4000)], axis=1)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.2)) * 2.0 + x[:, 2] + rng.normal(size=4000)
    df = spark.createDataFrame([(float(b), float(b > 1.5), a.tolist()) for a, b in zip(x, y)], "y double, one double, x array<double>")
    return df.select("y", "one", array_to_vector("x").alias("features"), "x").cache()


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_boosters_on_cells_give_the_trees_of_the_rows(rows, monkeypatch, kind):
    fitted, plain = [], GBTClassifier if kind == "classification" else GBTRegressor
    fit = plain._fit
    monkeypatch.setattr(plain, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    monkeypatch.setattr(ce, "CELL_ROWS", 1000)
    data = rows.withColumnRenamed("one" if kind == "classification" else "y", "label")
    small = estimator(kind, "gradient_boosting", {"maxIter": 6, "maxDepth": 3}).fit(data)
    monkeypatch.setattr(ce, "CELL_ROWS", 10_000)
    whole = estimator(kind, "gradient_boosting", {"maxIter": 6, "maxDepth": 3}).fit(data)
    assert fitted[0] <= 9 * 5 * 3 * 2 and fitted[1] == 4000
    assert [t.toDebugString.split("\n", 1)[1].count("If") for t in small.trees] == [t.toDebugString.split("\n", 1)[1].count("If") for t in whole.trees]
    assert np.allclose(small.featureImportances.toArray(), whole.featureImportances.toArray())
    a, b = (np.array([r[0] for r in m.transform(data).select("prediction").collect()]) for m in (small, whole))
    assert np.allclose(a, b)


def test_boosters_that_draw_rows_or_find_none_alike_read_all_rows(rows, monkeypatch):
    monkeypatch.setattr(ce, "CELL_ROWS", 1000)
    asked = []
    monkeypatch.setattr(ce, "cells", lambda *a: asked.append(a))
    data = rows.withColumnRenamed("y", "label")
    for params in ({"subsamplingRate": 0.8}, {"minInstancesPerNode": 2}):
        estimator("regression", "gradient_boosting", {"maxIter": 1, "maxDepth": 1, **params}).fit(data)
    assert not asked
    estimator("regression", "gradient_boosting", {"maxIter": 1, "maxDepth": 1}).fit(data)
    assert len(asked) == 1


def test_rows_lie_in_the_cell_where_the_cuts_put_them(spark):
    df = spark.range(5000).select(F.lit(1.0).alias("label"), array_to_vector(F.array((F.col("id") * 0.37) % 91, F.col("id") % 4 * 1.0)).alias("features"))
    out = ce.cells(df, 5000, 8, ["label"], _counted)
    found = [(r["features"].toArray(), r["n"]) for r in out.collect()]
    assert len(found) <= 32 and sum(n for _, n in found) == 5000
    values = sorted({v[0] for v, _ in found})
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    x = np.arange(5000) * 0.37 % 91
    wanted = np.bincount(np.searchsorted(cuts, x), minlength=len(values))
    assert [sum(n for v, n in found if v[0] == a) for a in values] == wanted.tolist()
    assert min(wanted) > 400 and {v[1] for v, _ in found} == {0.0, 1.0, 2.0, 3.0}
    assert ce.cells(df.withColumn("label", F.rand(1)), 5000, 16, ["label"], _counted) is None


def test_values_that_are_not_finite_stay_apart(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, float("nan"), float("inf"), float("-inf")] * 4], "v double")
    data = df.select(F.lit(0.0).alias("label"), array_to_vector(F.array("v")).alias("features"))
    found = sorted(str(float(r["features"][0])) for r in ce.cells(data, 20, 8, ["label"], _counted).collect())
    assert found == ["-inf", "1.0", "2.0", "inf", "nan"]


def test_poisson_draws_follow_the_law(spark):
    n = [r[0] for r in spark.range(20_000, numPartitions=4).select(F.rand(7).alias("u")).select(fs._poisson(F.col("u"), 0.8)).collect()]
    assert abs(np.mean(n) - 0.8) < 0.03 and abs(np.var(n) - 0.8) < 0.04 and abs(np.mean(np.array(n) == 0) - np.exp(-0.8)) < 0.015


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_importances_from_cells_are_near_those_from_rows(spark, rows, monkeypatch, kind):
    data = rows.select("one", "y", *[F.col("x")[i].alias(c) for i, c in enumerate("abc")])
    target, fitted = "one" if kind == "classification" else "y", []
    grown = ce.cells
    monkeypatch.setattr(ce, "cells", lambda *a: fitted.append(grown(*a)) or fitted[-1])
    whole = {r["feature"]: r["importance"] for r in fs.forest_importances(data, list("abc"), target, kind).collect()}
    assert not fitted
    monkeypatch.setattr(ce, "CELL_ROWS", 1000)
    small = {r["feature"]: r["importance"] for r in fs.forest_importances(data, list("abc"), target, kind).collect()}
    assert len(fitted) == 1 and abs(sum(small.values()) - 1) < 1e-9
    assert all(abs(small[f] - whole[f]) < 0.12 for f in "abc")


def test_regression_forests_on_cells_are_near_those_on_rows(rows, monkeypatch, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
    fitted, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    data = rows.withColumnRenamed("y", "label")
    params = {"numTrees": 12, "maxDepth": 3, "maxBins": 32, "featureSubsetStrategy": "all"}
    whole = estimator("regression", "random_forest", params).fit(data)
    assert fitted == [4000]
    monkeypatch.setattr(ce, "FOREST_ROWS", 1000)
    small = estimator("regression", "random_forest", params).fit(data)
    assert len(fitted) == 13 and max(fitted[1:]) <= 9 * 5 * 3 and small.getNumTrees == 12
    assert len({t.toDebugString.split("\n", 1)[1] for t in small.trees}) > 1
    a, b = (np.array([r[0] for r in m.transform(data).select("prediction").collect()]) for m in (small, whole))
    y = np.array([r[0] for r in data.select("label").collect()])
    assert abs(np.mean((a - y) ** 2) / np.mean((b - y) ** 2) - 1) < 0.1
    small.save(str(tmp_path / "forest"))
    again = RandomForestRegressionModel.load(str(tmp_path / "forest")).transform(data).select("prediction").collect()
    assert np.array_equal(a, [r[0] for r in again])


def test_draws_of_cells_are_sums_of_poisson_draws_of_their_rows(spark):
    df = spark.range(6000, numPartitions=3).select((F.col("id") % 3).cast("double").alias("a"), F.when(F.col("id") % 3 == 2, 5.0).otherwise(F.col("id") % 2 * 1.0).alias("y"))
    found = {r["a"]: r for r in ce.drawn(df, ["a"], "y", 20, 1.0, 7).collect()}
    assert sorted(found) == [0.0, 1.0, 2.0]
    w = np.array([[found[a][f"w{t}"] for t in range(20)] for a in found])
    assert abs(w.mean() / 2000 - 1) < 0.02 and 20 < w.std() < 80  # the deviation of a sum of 2000 draws is 45
    assert all(found[2.0][f"y{t}"] == 5.0 and abs(found[0.0][f"y{t}"] - 0.5) < 0.06 for t in range(20))


def test_forests_read_rows_where_cells_do_not_serve(rows, monkeypatch):
    monkeypatch.setattr(ce, "FOREST_ROWS", 1000)
    asked = []
    monkeypatch.setattr(ce, "cells", lambda *a, **k: asked.append(k["least"]))
    data = rows.withColumnRenamed("y", "label")
    for params in ({"minInstancesPerNode": 2}, {"bootstrap": False}, {"numTrees": 1}):
        estimator("regression", "random_forest", {"numTrees": 2, "maxDepth": 1, **params}).fit(data)
    assert not asked
    estimator("regression", "random_forest", {"numTrees": 20, "maxDepth": 1}).fit(data)
    assert asked == [5]
