"""Bounds of Euclidean silhouettes against all pairs of rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from loomwork.operators.euclidean_silhouette import euclidean_silhouette, euclidean_silhouettes


def _exact(x, labels):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), []
    for i, mine in enumerate(labels):
        own = labels == mine
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, labels == o].mean() for o in set(labels) if o != mine)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def _frame(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "low long, v array<double>, prediction int").select(
        "low", array_to_vector("v").alias("features"), "prediction")


@pytest.fixture(scope="module")
def blobs():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(m, s, (n, 3)) for m, s, n in ((0, 1, 250), (3, 0.5, 120), (1e4, 2, 29))] + [np.full((1, 3), 50.0)])
    return x, np.repeat([0, 3, 7, 9], [250, 120, 29, 1])


@pytest.mark.parametrize("cells", [2, 16, 1000])
def test_bounds_hold(spark, blobs, cells):
    x, labels = blobs
    want = _exact(x, labels)
    got = euclidean_silhouettes(_frame(spark, x, labels).repartition(5).withColumnRenamed("low", "key"), ["key"], cells).orderBy("key").collect()
    low, high = np.array([r["low"] for r in got]), np.array([r["high"] for r in got])
    assert len(got) == 400 and (low <= want + 1e-9).all() and (want <= high + 1e-9).all() and got[-1]["silhouette"] == 0
    if cells == 1000:
        assert (high - low).max() < 0.02  # k-means finds fewer centres than there are rows


def test_mean_within_tolerance(spark, blobs):
    x, labels = blobs
    r = euclidean_silhouette(_frame(spark, x, labels), tolerance=0.01, cells=8).first()
    assert r["low"] <= _exact(x, labels).mean() <= r["high"] and r["high"] - r["low"] <= 0.01 and r["rows"] == 400


def test_odd_tables(spark):
    one = _frame(spark, np.zeros((4, 2)), np.zeros(4))
    assert euclidean_silhouettes(one, []).collect() == [] and euclidean_silhouette(one).first()["silhouette"] is None
    assert euclidean_silhouettes(one.where("false"), []).collect() == []
    same = _frame(spark, np.zeros((4, 2)), np.array([0, 0, 1, 1]))
    assert [r["silhouette"] for r in euclidean_silhouettes(same, []).collect()] == [0.0] * 4
