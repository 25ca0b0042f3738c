"""Factorization machines for squared loss from summed moments.

A machine over features x is linear in the products of its features: prediction = t . p(x) with p(x) = (1, x_i, x_i x_j for i < j)
and t a function of the intercept, the weights and the factors. Loss and gradient over all rows thus follow from the sums of
p p' and p y. One pass adds them up inside the tasks; the rounds of the AdamW solver, which are those of Spark's
``FMRegressor``, then cost the same whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features up to which the moments are summed (302 products, 91,204 sums); wider rows are fitted by Spark's solver.
MOST_FEATURES = 24
_BETAS, _EPSILON = (0.9, 0.999), 1e-8


def products(x: np.ndarray) -> np.ndarray:
    """(1, x_i, x_i x_j for i < j) of every row."""
    i, j = np.triu_indices(x.shape[1], 1)
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def _summed(width: int):
    """(label, x) -> (cell, value): the sums of z z' of a task, z being the products and the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            z = np.concatenate([products(x), batch.column(0).to_numpy(zero_copy_only=False)[:, None]], axis=1)
            total = total + z.T @ z
        flat = np.ravel(total)
        if len(flat) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    return run


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sums of z z' over all rows (``label`` double, ``x`` array of doubles), z = (products of x, label)."""
    sums = rows.mapInArrow(_summed(width), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    size = 2 + width + width * (width - 1) // 2
    out = np.zeros(size * size)
    for r in sums.collect():  # a row per pair of products
        out[r["cell"]] = r["value"]
    return out.reshape(size, size)


class FactorizationMachine(Estimator):
    """``FMRegressor`` and its parameters; up to ``MOST_FEATURES`` features its full-batch AdamW rounds run on summed moments."""

    def __init__(self, **params):
        super().__init__()
        self.by_spark = FMRegressor(**params)

    def _get(self, name: str):
        return self.by_spark.getOrDefault(name)

    def _fit(self, dataset: DataFrame) -> Model:
        label, x = F.col(self._get("labelCol")).cast("double"), vector_to_array(self._get("featuresCol"))
        first = dataset.select(x.alias("x")).where("x is not null").first()
        if first is None:
            raise ValueError("no rows to fit")
        width = len(first["x"])
        if width > MOST_FEATURES or self._get("solver") != "adamW" or self._get("miniBatchFraction") != 1.0:
            return self.by_spark.fit(dataset)

        def odd(c: Column) -> Column:
            return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

        bad_x = F.col("x").isNull() | F.exists("x", odd)
        rows = dataset.select(label.alias("label"), x.alias("x")).select(
            F.when(odd(F.col("label")), F.raise_error(F.lit("labels must be finite numbers"))).otherwise(F.col("label")).alias("label"),
            F.when(bad_x, F.raise_error(F.lit("features must be finite numbers"))).otherwise(F.col("x")).alias("x"))
        rng = dataset.sparkSession.sparkContext._jvm.java.util.Random(self._get("seed"))  # the numbers Spark starts from
        factors = np.array([rng.nextGaussian() for _ in range(width * self._get("factorSize"))]).reshape(width, -1) * self._get("initStd")
        return FittedMachine(*self._solved(moments(rows, width), factors), self._get("featuresCol"))

    def _solved(self, sums: np.ndarray, factors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Intercept, weights and factors after the rounds of AdamW, from the sums of ``moments`` and the first factors."""
        width, size = factors.shape
        i, j = np.triu_indices(width, 1)
        n, pp, py = sums[0, 0], sums[:-1, :-1], sums[:-1, -1]
        line, const = self._get("fitLinear"), self._get("fitIntercept")
        w = np.concatenate([factors.ravel(), np.zeros(width * line + const)])
        first, second, powers = np.zeros_like(w), np.zeros_like(w), [1.0, 1.0]
        for _ in range(self._get("maxIter")):
            v, weights, intercept = _split(w, width, size, line, const)
            slope = 2 / n * (pp @ np.concatenate([[intercept], weights, np.einsum("pf,pf->p", v[i], v[j])]) - py)
            crossed = np.zeros((width, width))
            crossed[i, j] = crossed[j, i] = slope[1 + width:]
            gradient = np.concatenate([(crossed @ v).ravel(), slope[1:1 + width] if line else [], slope[:1] if const else []])
            first = _BETAS[0] * first + (1 - _BETAS[0]) * gradient
            second = _BETAS[1] * second + (1 - _BETAS[1]) * gradient * gradient
            powers = [p * b for p, b in zip(powers, _BETAS)]
            step = first / (1 - powers[0]) / (np.sqrt(second / (1 - powers[1])) + _EPSILON)
            before, w = w, w - (self._get("stepSize") * step + self._get("regParam") * w)
            if np.linalg.norm(before - w) < self._get("tol") * max(np.linalg.norm(w), 1.0):
                break
        v, weights, intercept = _split(w, width, size, line, const)
        return float(intercept), weights, v


def _split(w: np.ndarray, width: int, size: int, line: bool, const: bool) -> tuple[np.ndarray, np.ndarray, float]:
    cut = width * size
    return w[:cut].reshape(width, size), w[cut:cut + width] if line else np.zeros(width), w[-1] if const else 0.0


class FittedMachine(Model, MLWritable, MLReadable):
    """Intercept, linear weights and factors; ``transform`` adds ``prediction``."""

    def __init__(self, intercept: float = 0.0, linear: np.ndarray | None = None, factors: np.ndarray | None = None, features_col: str = "features"):
        super().__init__()
        self.intercept, self.features_col = intercept, features_col
        self.linear, self.factors = np.zeros(0) if linear is None else np.asarray(linear), np.zeros((0, 0)) if factors is None else np.asarray(factors)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        i, j = np.triu_indices(len(self.linear), 1)
        weights = np.concatenate([[self.intercept], self.linear, np.einsum("pf,pf->p", self.factors[i], self.factors[j])])

        @F.pandas_udf("double")
        def predicted(rows: pd.Series) -> pd.Series:
            return pd.Series(products(np.stack([np.asarray(r, np.float64) for r in rows])) @ weights if len(rows) else np.zeros(0))

        return dataset.withColumn("prediction", predicted(vector_to_array(self.features_col)))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: FittedMachine):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        extra = {"intercept": m.intercept, "linear": m.linear.tolist(), "factors": m.factors.tolist(), "features_col": m.features_col}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extra)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedMachine:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(meta["intercept"], meta["linear"], meta["factors"], meta["features_col"])
        model._resetUid(meta["uid"])
        return model
