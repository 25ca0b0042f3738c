"""Regularised mixtures: rising likelihood, collapsed components, odd tables, saved models."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomwork.operators.mixture import Mixture, MixtureModel, RegularisedMixture, em_step, table_prior


def _frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, x array<double>").withColumn("features", array_to_vector("x"))


def _blobs(n=300):
    r = np.random.default_rng(5)
    return np.concatenate([r.normal([0, 0], [1, 0.2], (n, 2)), r.normal([8, 3], [0.3, 1], (n, 2))])


def test_step_equals_plain_sums(spark):
    x = _blobs(60)
    rows = _frame(spark, x.tolist()).repartition(5).select("x")
    prior = table_prior(rows, 2, 0.1)
    start = Mixture(np.array([0.3, 0.7]), np.array([[1.0, 1.0], [5.0, 2.0]]), np.array([[[2.0, 0.3], [0.3, 1.0]], [[1.0, 0.0], [0.0, 4.0]]]))
    after, value = em_step(rows, start, prior)
    dense = np.array([[w * np.exp(-(p - m) @ np.linalg.inv(c) @ (p - m) / 2) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
                       for w, m, c in zip(start.weights, start.means, start.covariances)] for p in x])
    shares = dense / dense.sum(axis=1, keepdims=True)
    for j in range(2):
        n = shares[:, j].sum()
        mean = shares[:, j] @ x / n
        scatter = sum(s * np.outer(p - mean, p - mean) for s, p in zip(shares[:, j], x))
        assert np.allclose(after.weights[j], (n + 1) / (len(x) + 2)) and np.allclose(after.means[j], mean)
        assert np.allclose(after.covariances[j], (scatter + prior.rows * np.diag(x.var(axis=0))) / (n + prior.rows))
    assert np.isclose(value, np.log(dense.sum(axis=1)).sum() + prior.penalty(start))


def test_finds_blobs_and_survives_a_collapsed_component(spark, tmp_path):
    df = _frame(spark, _blobs().tolist())
    model = RegularisedMixture(initialMeans=[[0.0, 0.0], [8.0, 3.0], [1e5, -1e5]], maxIter=30).fit(df)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.history, model.history[1:]))
    assert np.allclose(model.mixture.means[:2], [[0, 0], [8, 3]], atol=0.2) and np.allclose(model.mixture.means[2], [1e5, -1e5])
    assert model.mixture.weights[2] == pytest.approx(1 / 603) and np.isfinite(model.mixture.covariances).all()
    got = model.transform(df)
    assert {tuple(r) for r in got.groupBy("prediction", (F.col("id") >= 300).alias("late")).count().collect()} == {(0, False, 300), (1, True, 300)}
    model.write().save(str(tmp_path / "m"))
    again = MixtureModel.load(str(tmp_path / "m")).transform(df)
    assert got.select("id", "prediction", vector_to_array("probability")).exceptAll(again.select("id", "prediction", vector_to_array("probability"))).count() == 0


def test_odd_tables(spark):
    with pytest.raises(ValueError, match="no rows"):
        RegularisedMixture(k=2).fit(_frame(spark, [[0.0]]).where("id < 0"))
    with pytest.raises(ValueError, match="no finite"):
        RegularisedMixture(k=2).fit(_frame(spark, [[0.0], [float("nan")], [float("inf")]]))
    with pytest.raises(ValueError, match="above zero"):
        RegularisedMixture(regParam=0.0)
    # equal rows, a constant column and more components than different rows
    same = _frame(spark, [[1.0, 7.0]] * 20)
    model = RegularisedMixture(k=3, maxIter=5).fit(same)
    assert np.isfinite(model.mixture.covariances).all() and model.transform(same).select("prediction").distinct().count() == 1
    # null features are left out of the fit and get nulls
    holes = _frame(spark, [[float(i % 2) * 9 + i / 100] for i in range(40)]).withColumn("features", F.when(F.col("id") != 3, F.col("features")))
    out = RegularisedMixture(k=2, maxIter=10).fit(holes).transform(holes)
    assert out.where("prediction is null").select("id", "probability").collect() == [(3, None)]
    assert out.where("prediction is not null").groupBy("prediction", F.col("id") % 2).count().count() == 2
