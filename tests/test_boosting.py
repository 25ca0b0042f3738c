"""Histogram boosting against a plain exact booster, and its model's round trip."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array

from loomwork.operators import boosting as bo


def frame(spark, x, y):
    rows = spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(x.astype(float).tolist(), y))], "id long, x array<double>, label double")
    return rows.repartition(3).select("id", array_to_vector("x").alias("features"), "label")


def slopes(objective, m, y, k):
    if objective == "squared":
        return m[:, 0] - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-m[:, 0])) if objective == "logistic" else (np.exp(m) / np.exp(m).sum(1, keepdims=True))[:, k]
    return p - (y if objective == "logistic" else y == k), p * (1 - p)


def grow(x, g, h, rows, depth, lam, step, out):
    """Best split over all values and both sides for missing ones, straight from the definition."""
    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + lam)
    best = None
    for f in range(x.shape[1]) if depth else ():
        v = x[rows, f]
        lost = np.isnan(v)
        values = np.unique(v[~lost])
        for cut in values:
            for missing_left in (False, True) if lost.any() else (False,):
                low = (v <= cut) | (lost & missing_left)
                a, b = rows[low], rows[~low]
                if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= 1e-3:
                    gain = (part(a) + part(b) - part(rows)) / 2
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, a, b)
    if best is None:
        out[rows] += -step * g[rows].sum() / (h[rows].sum() + lam) if len(rows) < len(x) else 0.0
        return
    grow(x, g, h, best[1], depth - 1, lam, step, out)
    grow(x, g, h, best[2], depth - 1, lam, step, out)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 12, 400), rng.integers(0, 7, 400), rng.integers(0, 3, 400)], axis=1).astype(float)
    signal = x[:, 0] * (x[:, 1] > 3) + 3 * (x[:, 2] == 1) + rng.normal(size=400)
    x[rng.random(400) < 0.15, 0] = np.nan
    signal[np.isnan(x[:, 0])] += 6
    return x, signal


@pytest.mark.parametrize("objective", bo.OBJECTIVES)
def test_margins_equal_the_definition(spark, table, objective, monkeypatch):
    monkeypatch.setattr(bo, "ROUNDS_PER_STAGE", 2)
    x, signal = table
    y = signal if objective == "squared" else (signal > 5).astype(float) if objective == "logistic" else np.digitize(signal, [2, 6]).astype(float)
    classes = 3 if objective == "softmax" else 1
    df = frame(spark, x, y)
    model = bo.HistogramBoosting(objective=objective, classes=3, maxIter=5, maxDepth=3, maxBins=200, stepSize=0.4).fit(df)
    margin = np.tile(model.start, (400, 1))
    for _ in range(5):
        new = np.zeros_like(margin)
        for k in range(classes):
            g, h = slopes(objective, margin, y, k)
            grow(x, g, h, np.arange(400), 3, 1.0, 0.4, new[:, k])
        margin = margin + new
    got = model.transform(df).select("id", "prediction").orderBy("id").collect()
    m = df.select("id", model.margins(vector_to_array("features")).alias("m")).orderBy("id").collect()
    assert np.allclose(np.array([r["m"] for r in m]), margin, atol=1e-8)
    want = margin[:, 0] if objective == "squared" else margin[:, 0] > 0 if objective == "logistic" else margin.argmax(1)
    assert np.allclose([r["prediction"] for r in got], want)


def test_model_round_trip_and_importances(spark, table, tmp_path):
    x, signal = table
    df = frame(spark, x, np.digitize(signal, [2, 6]))
    model = bo.HistogramBoosting(objective="softmax", classes=3, maxIter=3, maxDepth=2).fit(df)
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    cols = ["id", "prediction", "probability", "rawPrediction"]
    assert sorted(model.transform(df).select(*cols).collect(), key=lambda r: r["id"]) == sorted(again.transform(df).select(*cols).collect(), key=lambda r: r["id"])
    assert sum(model.importances()) == pytest.approx(1) and model.nodes(spark).where("feature >= 0").count() > 5


def test_odd_inputs(spark):
    none = frame(spark, np.zeros((0, 2)), [])
    with pytest.raises(ValueError):
        bo.HistogramBoosting().fit(none)
    with pytest.raises(ValueError):
        bo.HistogramBoosting(objective="huber")
    flat = frame(spark, np.full((10, 2), np.nan), np.arange(10))
    model = bo.HistogramBoosting(maxIter=3).fit(flat)
    assert {r["prediction"] for r in model.transform(flat).collect()} == {4.5}
    one = frame(spark, np.arange(10).reshape(-1, 1), np.ones(10))
    assert {round(r["probability"][1], 3) for r in bo.HistogramBoosting(objective="logistic", maxIter=2).fit(one).transform(one).collect()} == {1.0}
    with pytest.raises(ValueError):
        bo.HistogramBoosting(objective="softmax", classes=2).fit(frame(spark, np.zeros((3, 1)), [0, 1, 2]))


def test_walk_over_bins_reaches_the_same_nodes():
    from loomwork.operators.boosting import MISSING, Tree, _matrix, _walk
    rng = np.random.default_rng(4)
    tree = Tree.root(0, 0)
    for node, feature, cut, lost in ((0, 1, 7, True), (1, 0, 3, False), (4, 2, 250, True)):
        tree.left[node], tree.right[node] = tree.leaf(1.0), tree.leaf(2.0)
        tree.feature[node], tree.bin[node], tree.missing_left[node] = feature, cut, lost
    bins = rng.integers(0, 12, size=(500, 3)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.1] = MISSING
    assert (_walk(tree)(bins) == tree.places(bins, bins == MISSING, tree.bin)).all()
    assert (_walk(Tree.root(0, 0))(bins) == 0).all()
    column = pa.array([r.tobytes() for r in bins], pa.binary())
    assert (_matrix(column, 3, np.uint8) == bins).all() and (_matrix(column[100:300], 3, np.uint8) == bins[100:300]).all()
    assert _matrix(column[:0], 3, np.uint8).shape == (0, 3)
