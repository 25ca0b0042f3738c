"""Clustering run: prepare, sweep k, judge on every dataset, choose, profile, save."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import choose as ch
from loomwork.operators import cluster_profile as cp
from loomwork.operators import clustering_metrics as cu
from loomwork.operators import encode as en
from loomwork.operators import profile as pf
from loomwork.operators import tune as tn
from loomwork.operators.adaptive import SEARCHES
from loomwork.operators.dbscan import dbscan, dbscan_search
from loomwork.operators.models import estimator
from loomwork.operators.score import apply_model
from loomwork.operators.split import assign_split
from loomwork.plans.supervised import KEY, with_key
from loomwork.session import evenly, stage
from loomwork.sources.sinks import save_model, write_run

INDICES = ["silhouette", "calinski_harabasz", "davies_bouldin", "inertia", "num_clusters"]
# Fixed value: shares of the automatic split of a clustering input.
SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


class ClusteringRun:
    """Automatic clustering of a table.

    Hold-outs that lack a needed column are left out and named in ``holdout_report``. After ``fit``: ``sweep`` (indices per model and k), ``metrics`` (model, dataset, metric, value), ``ranking``,
    ``assignments`` (key, dataset, cluster) of the best model, and ``profile()``.
    """

    def __init__(self, models: list[str] | None = None, ks: list[int] | None = None, criterion: str = "silhouette",
                 use_elbow: bool = True, tune: str | None = None, trials: int = 4, cross_validation: bool = False,
                 folds: int = 5, seed: int = 42, shares: dict[str, float] | None = None, impute: float = 0.0,
                 density_grid: tuple[list[float], list[int]] | None = None):
        self.models = models or ["kmeans", "bisecting_kmeans"]
        self.ks, self.criterion, self.use_elbow = ks or list(range(2, 11)), criterion, use_elbow
        self.tune, self.trials, self.cross_validation, self.folds = tune, trials, cross_validation, folds
        self.seed, self.shares, self.impute = seed, shares or SHARES, impute
        self.density_grid = density_grid or (None, None)

    def fit(self, df: DataFrame, keys: list[str], holdouts: dict[str, DataFrame] | None = None):
        names = pf.drop_date_columns(df, [c for c in df.columns if c not in keys])
        self.spec = en.clustering_spec(df.select(*names), self.impute)
        self.keys = keys
        keyed = with_key(df, keys)
        self.input = keyed
        cols = [KEY, "dataset", *self.spec.raw]
        self.holdout_report = en.holdout_report(holdouts, self.spec.raw, df.sparkSession) if holdouts else None
        if holdouts:
            usable = {r["dataset"] for r in self.holdout_report.where("usable").collect()}
            holdouts = {n: d for n, d in holdouts.items() if n in usable}
            whole = keyed.withColumn("dataset", F.lit("train")).select(*cols)
            for name, other in holdouts.items():
                whole = whole.unionByName(with_key(other, keys).withColumn("dataset", F.lit(name)).select(*cols))
        else:
            whole = assign_split(keyed, [KEY], self.shares, self.seed).select(*cols)
        ready = stage(evenly(en.prepare_columns(whole, self.spec), KEY), "prepared")
        self.encoder = en.fit_encoder(ready.where("dataset = 'train'"), self.spec)
        self.rows = stage(self.encoder.transform(ready).select(KEY, "dataset", "features"), "encoded")
        train = self.rows.where("dataset = 'train'")
        self.fitted, self.sweeps, self.cv, parts = {}, {}, {}, None
        for name in self.models:
            if name == "dbscan":
                # density clusters have no model for unseen rows: all rows are clustered together
                labels, table = dbscan_search(self.rows, [KEY], "features", *self.density_grid)
                self.sweeps[name], assigned = table, self.rows.join(labels, KEY)
                best = table.where("valid").orderBy(F.col("silhouette").desc(), "eps", "min_points").first()
                self.density = (best["eps"], best["min_points"])
            else:
                params = {}
                if self.tune:
                    params = tn.best_params(SEARCHES[self.tune]("clustering", name, train, n=self.trials, seed=self.seed, keys=[KEY]))
                    params.pop("k", None)
                self.sweeps[name], fitted = tn.sweep_k(name, train, self.ks, params)
                k = self._best_k(self.sweeps[name])
                self.fitted[name] = fitted[k]
                if self.cross_validation:
                    self.cv[name] = tn.cross_validate_clusters(name, train, [KEY], {**params, "k": k}, self.folds)
                assigned = fitted[k].transform(self.rows)
            part = assigned.select(F.lit(name).alias("model"), KEY, "dataset", "features", F.col("prediction").cast("int").alias("prediction"))
            parts = part if parts is None else parts.unionByName(part)
        self.assigned = stage(parts, "assigned")
        self.metrics = stage(self._metrics(), "metrics")
        self.ranking = stage(ch.choose_clusterer(self.metrics, self.criterion), "ranking")
        self.champion = self.ranking.where("rank = 1").first()["model"]
        self.assignments = self.assigned.where(F.col("model") == self.champion).select(KEY, "dataset", F.col("prediction").alias("cluster"))
        if self.champion in self.fitted:
            self.model = PipelineModel(stages=[*self.encoder.stages, self.fitted[self.champion]])
        return self

    def _best_k(self, sweep: DataFrame) -> int:
        """Elbow when asked for and defined, else the best silhouette."""
        bend = ch.elbow(sweep).first() if self.use_elbow else None
        if bend is not None:
            return bend["k"]
        return sweep.orderBy(F.col("silhouette").desc(), "k").first()["k"]

    def _metrics(self) -> DataFrame:
        out = None
        for r in self.assigned.select("model", "dataset").distinct().collect():
            rows = self.assigned.where((F.col("model") == r["model"]) & (F.col("dataset") == r["dataset"])
                                       & (F.col("prediction") != cu.NOISE))
            long = cu.all_indices(rows).select(*[F.col(c).cast("double").alias(c) for c in INDICES]).unpivot(
                [], INDICES, "metric", "value").select(F.lit(r["model"]).alias("model"), F.lit(r["dataset"]).alias("dataset"), "metric", "value")
            out = long if out is None else out.unionByName(long)
        return out

    def labelled(self) -> DataFrame:
        """Input rows with their cluster."""
        return self.input.join(self.assignments.select(KEY, "cluster"), KEY).drop(KEY)

    def profile(self) -> dict[str, DataFrame]:
        """Profiles of the chosen clusters over the raw columns."""
        rows = stage(self.labelled(), "labelled")
        out = {"insights": cp.cluster_insights(rows, self.spec.numeric, self.spec.categorical)}
        if self.spec.numeric:
            out["numeric"] = cp.numeric_profile(rows, self.spec.numeric)
            out["distinctive"] = cp.distinctive_variables(rows, self.spec.numeric)
        if self.spec.categorical:
            out["categorical"] = cp.categorical_profile(rows, self.spec.categorical)
            out["dominant"] = cp.dominant_category(rows, self.spec.categorical)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Input rows with their cluster. Density clusters have no model: the given rows are clustered anew."""
        if self.champion == "dbscan":
            keyed = with_key(df, self.keys)
            ready = self.encoder.transform(en.prepare_columns(keyed, self.spec))
            labels = dbscan(ready.select(KEY, "features"), [KEY], *self.density).select(KEY, "prediction")
            return keyed.join(labels, KEY).drop(KEY)
        return apply_model(df, self.spec, self.model, "clustering")

    def save_tables(self, path: str) -> None:
        """Assignments, metrics, ranking, sweeps and profiles of the run."""
        write_run(path, {"assignments": self.assignments, "metrics": self.metrics, "ranking": self.ranking,
                         **{f"sweep_{n}": t for n, t in self.sweeps.items()}, **{f"profile_{n}": t for n, t in self.profile().items()}})

    def save(self, path: str) -> None:
        """The tables of the run and its model."""
        if self.champion == "dbscan":
            raise ValueError("a density clustering has no model to save; use save_tables")
        self.save_tables(path)
        save_model(self.model, path, {"kind": "clustering", "spec": asdict(self.spec), "champion": self.champion,
                                      "features": self.spec.encoded})
