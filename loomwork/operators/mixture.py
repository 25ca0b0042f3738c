"""Gaussian mixtures with regularised covariances.

Expectation maximisation over sums: a pass weighs every row against the present mixture inside the tasks and adds up rows,
first and second moments per component. Only these sums are shuffled and reach the driver; their number is that of the
model's own parameters, never that of the rows. A prior of ``regParam`` times an average component's rows, spread as the
whole table is along every feature, shrinks the covariances, and one prior row a component keeps the weights above zero.
Each step raises the penalised likelihood; a component that loses all its rows keeps its mean and goes back to the prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import stage, staging

#: Rounds of k-means that find the first means.
START_ROUNDS = 10
#: Prior rows of every component in its weight.
WEIGHT_ROWS = 1.0


@dataclass
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, one column a component."""
        out = np.empty((len(x), len(self.weights)))
        for j, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(covariance)
            z = np.linalg.solve(root, (x - mean).T)
            out[:, j] = math.log(weight) - (z * z).sum(axis=0) / 2 - np.log(np.diag(root)).sum() - len(mean) * math.log(2 * math.pi) / 2
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of every component in every row, and the rows' log-likelihoods."""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        shares = np.exp(logs - top)
        total = shares.sum(axis=1, keepdims=True)
        return shares / total, (top + np.log(total))[:, 0]


@dataclass(frozen=True)
class Prior:
    """``rows`` prior rows a component with the variances ``spread`` around its mean; ``total`` is the number of rows fitted."""

    total: int
    rows: float
    spread: np.ndarray

    def penalty(self, mixture: Mixture) -> float:
        """What the prior adds to the log-likelihood of a mixture."""
        out = WEIGHT_ROWS * float(np.log(mixture.weights).sum())
        for covariance in mixture.covariances:
            out -= self.rows / 2 * (np.linalg.slogdet(covariance)[1] + float((np.diag(np.linalg.inv(covariance)) * self.spread).sum()))
        return out


def _points(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _moments(mixture: Mixture):
    """Per component rows, first and second moments about its mean, and in component -1 the log-likelihood."""
    k, d = mixture.means.shape
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, likelihood = np.zeros((k, 1 + d + len(upper[0]))), 0.0
        for batch in batches:
            x = _points(batch.column(0), d)
            shares, logs = mixture.responsibilities(x)
            likelihood += logs.sum()
            for j in range(k):
                away, weight = x - mixture.means[j], shares[:, j]
                sums[j, 0] += weight.sum()
                sums[j, 1:1 + d] += weight @ away
                sums[j, 1 + d:] += ((away * weight[:, None]).T @ away)[upper]
        width = sums.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(np.repeat(np.arange(k), width), -1), pa.int32()), pa.array(np.append(np.tile(np.arange(width), k), 0), pa.int32()),
            pa.array(np.append(sums.ravel(), likelihood))], names=["component", "place", "value"])

    return run


def em_step(rows: DataFrame, mixture: Mixture, prior: Prior) -> tuple[Mixture, float]:
    """The mixture after one step over ``rows`` (column x), and the penalised log-likelihood of the given one."""
    k, d = mixture.means.shape
    upper = np.triu_indices(d)
    sums = rows.select("x").mapInArrow(_moments(mixture), "component int, place int, value double")
    added, likelihood = np.zeros((k, 1 + d + len(upper[0]))), 0.0
    for r in sums.groupBy("component", "place").agg(F.sum("value").alias("value")).collect():  # one row per parameter of the model
        if r["component"] < 0:
            likelihood = r["value"]
        else:
            added[r["component"], r["place"]] = r["value"]
    weights = (added[:, 0] + WEIGHT_ROWS) / (prior.total + k * WEIGHT_ROWS)
    means, covariances = mixture.means.copy(), np.empty((k, d, d))
    for j in range(k):
        n, first = added[j, 0], added[j, 1:1 + d]
        second = np.zeros((d, d))
        second[upper] = added[j, 1 + d:]
        second = second + second.T - np.diag(np.diag(second))
        if n > 0:
            second -= np.outer(first, first) / n
            means[j] += first / n
        covariances[j] = (second + prior.rows * np.diag(prior.spread)) / (n + prior.rows)
    return Mixture(weights, means, covariances), likelihood + prior.penalty(mixture)


def table_prior(rows: DataFrame, k: int, share: float) -> Prior:
    """The prior that the rows (column x) give: variances of all features, 1 for a constant one.

    NaN and infinite coordinates, and vectors of several widths, are an error.
    """
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not head["n"]:
        raise ValueError("no rows to fit")
    if head["bad"] or head["low"] != head["high"]:
        raise ValueError(f"{head['bad']} rows have coordinates that are no finite numbers; vectors have {head['low']} to {head['high']} features")
    wide = rows.agg(*[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(head["high"])]).first()
    spread = np.array([v if v > 0 else 1.0 for v in wide])
    return Prior(head["n"], share * head["n"] / k, spread)


class RegularisedMixture(Estimator):
    """Estimator over a ``features`` vector. Rows with null features are left out of the fit.

    ``regParam`` is the prior's weight as a share of an average component's rows. The first means are those of k-means unless
    ``initialMeans`` gives them; the fit ends when a round raises the penalised log-likelihood by less than ``tol`` a row.
    """

    def __init__(self, featuresCol: str = "features", k: int = 3, maxIter: int = 100, tol: float = 1e-4, regParam: float = 0.01,  # noqa: N803
                 seed: int = 42, initialMeans: list[list[float]] | None = None):  # noqa: N803
        super().__init__()
        if regParam <= 0:
            raise ValueError("regParam is above zero: without it a covariance may vanish")
        self.features_col, self.k, self.rounds, self.tol, self.share, self.seed, self.first = featuresCol, k, maxIter, tol, regParam, seed, initialMeans

    def _fit(self, dataset: DataFrame) -> MixtureModel:
        with staging(dataset.sparkSession):
            there = dataset.where(F.col(self.features_col).isNotNull())
            rows = stage(there.select(vector_to_array(self.features_col).alias("x")), "points")
            if self.first is None:
                prior = table_prior(rows, self.k, self.share)
                start = KMeans(k=self.k, maxIter=START_ROUNDS, seed=self.seed, featuresCol="v").fit(rows.select(array_to_vector("x").alias("v")))
                means = np.array(start.clusterCenters())
            else:
                means = np.array(self.first, float)
                prior = table_prior(rows, len(means), self.share)
            k, d = means.shape  # k-means finds fewer centres where there are fewer different rows
            mixture, history = Mixture(np.full(k, 1 / k), means, np.repeat(np.diag(prior.spread)[None], k, axis=0)), []
            for _ in range(self.rounds):
                after, value = em_step(rows, mixture, prior)
                history.append(value)
                if len(history) > 1 and value - history[-2] < self.tol * prior.total:
                    break
                mixture = after
            return MixtureModel(mixture, self.features_col, history)


class MixtureModel(Model, MLWritable, MLReadable):
    """Fitted mixture. ``transform`` adds probability (share of every component) and prediction; null features give nulls.

    ``history`` has the penalised log-likelihood before every round.
    """

    def __init__(self, mixture: Mixture | None = None, features_col: str = "features", history: list[float] | None = None):
        super().__init__()
        self.mixture, self.features_col, self.history = mixture, features_col, history or []

    def shares(self, x: Column) -> Column:
        mixture = self.mixture

        @F.pandas_udf("array<double>")
        def shares(rows: pd.Series) -> pd.Series:
            there = rows.notna()
            if not there.any():
                return rows
            found = iter(mixture.responsibilities(np.stack([np.asarray(r, float) for r in rows[there]]))[0])
            return pd.Series([next(found) if t else None for t in there])

        return shares(x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("_shares", self.shares(F.when(F.col(self.features_col).isNotNull(), vector_to_array(self.features_col))))
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("int")
        return out.withColumn("probability", F.when(F.col("_shares").isNotNull(), array_to_vector("_shares"))).withColumn("prediction", best).drop("_shares")

    def components(self, spark: SparkSession) -> DataFrame:
        """The model as a table, one row per component."""
        m = self.mixture
        rows = [(j, float(m.weights[j]), m.means[j].tolist(), m.covariances[j].tolist()) for j in range(len(m.weights))]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<array<double>>")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Settings as metadata, components as a Parquet table beside it."""

    def __init__(self, model: MixtureModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"features_col": self.model.features_col, "history": self.model.history})
        self.model.components(self.sparkSession).coalesce(1).write.parquet(f"{path}/components")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> MixtureModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/components").orderBy("component").collect()  # a row per component
        mixture = Mixture(*[np.array([r[c] for r in rows]) for c in ("weight", "mean", "covariance")])
        model = self.cls(mixture, meta["features_col"], meta["history"])
        model._resetUid(meta["uid"])
        return model
