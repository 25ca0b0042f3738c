"""Regression run: prepare, fit models, judge them on every dataset, choose, predict, save."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import choose as ch
from loomwork.operators import profile as pf
from loomwork.operators import regression_metrics as rm
from loomwork.operators import tune as tn
from loomwork.operators.adaptive import SEARCHES
from loomwork.operators.models import available_models, estimator
from loomwork.operators.score import apply_model
from loomwork.operators.split import use_cross_validation
from loomwork.plans.supervised import KEY, Settings, feature_spec, prepare_rows
from loomwork.session import stage
from loomwork.sources.sinks import save_model, write_run

METRICS = ["rmse", "mae", "r2", "mse", "mape", "explained_variance"]


class RegressionRun:
    """Automatic regression on a table; attributes as in the classification run."""

    def __init__(self, **settings):
        self.settings = Settings(**settings)

    def fit(self, train: DataFrame, target: str, keys: list[str], holdouts: dict[str, DataFrame] | None = None):
        s = self.settings
        self.criterion = s.criterion or "rmse"
        if s.sample_fraction < 1.0:
            train = train.sample(False, s.sample_fraction, s.seed)

        self.coder = pf.fit_target(train, target, s.most_lost_targets)

        def labelled(df: DataFrame) -> DataFrame:
            return self.coder.apply(df).withColumn("label", F.col(target))

        self.dropped = {n: self.coder.dropped(d).first()["dropped"] for n, d in {"train": train, **(holdouts or {})}.items() if target in d.columns}

        spec = feature_spec(train, target, keys, s)
        self.prepared = prepare_rows(labelled(train), {n: labelled(d) if target in d.columns else d for n, d in (holdouts or {}).items()},
                                     target, keys, "regression", s, spec)
        self.rows = train.count()
        self.cross_validated = train.sparkSession.range(1).select(
            use_cross_validation(F.lit(self.rows), s.cross_validation, bool(holdouts), s.cross_validate_below).alias("cv")).first()["cv"]
        self._fit_models()
        return self

    def _fit_models(self) -> None:
        s, p = self.settings, self.prepared
        self.fitted, scored, self.trials, self.cross_validation = {}, None, {}, None
        for name in s.models or available_models("regression"):
            variants = {"default": {}}
            if s.tune:
                run = SEARCHES[s.tune]
                self.trials[name] = run("regression", name, p.train, p.dataset("valid"), n=s.trials, seed=s.seed, keys=[KEY])
                variants["tuned"] = tn.best_params(self.trials[name])
            for variant, params in variants.items():
                model = estimator("regression", name, params).fit(p.train)
                self.fitted[name, variant] = model
                part = model.transform(p.rows).select(
                    F.lit(name).alias("model"), F.lit(variant).alias("variant"), "dataset", KEY,
                    F.col("label").alias("actual"), "prediction")
                scored = part if scored is None else scored.unionByName(part)
                if self.cross_validated:
                    whole = p.rows.where(F.col("dataset").isin(*s.shares))
                    cv = tn.cross_validate("regression", name, whole, [KEY], params=params, folds=s.folds).select(
                        F.lit(name).alias("model"), F.lit(variant).alias("variant"), "folds", "mean", "std")
                    self.cross_validation = cv if self.cross_validation is None else self.cross_validation.unionByName(cv)
        self.scored = stage(scored, "scored")
        groups = ["model", "variant", "dataset"]
        wide = rm.regression_metrics(self.scored, groups=groups)
        self.metrics = stage(wide.unpivot(groups, METRICS, "metric", "value"), "metrics")
        chosen, self.decisions, self.variant = self.metrics.where("variant = 'default'"), None, "default"
        if s.tune:
            self.decisions = stage(ch.tuned_decisions(self.metrics, self.criterion, "regression", s.dataset), "decisions")
            chosen = self.metrics.join(self.decisions.select("model", F.col("decision").alias("variant")), ["model", "variant"])
        datasets = [r["dataset"] for r in self.metrics.select("dataset").distinct().collect()]
        self.ranking = stage(ch.choose_regressor(chosen.drop("variant"), self.criterion, s.dataset, datasets), "ranking")
        self.champion = self.ranking.where("rank = 1").first()["model"]
        if self.decisions is not None:
            self.variant = self.decisions.where(F.col("model") == self.champion).first()["decision"]
        self.model = PipelineModel(stages=[*p.encoder.stages, self.fitted[self.champion, self.variant]])

    def diagnostics(self, dataset: str = "valid") -> dict[str, DataFrame]:
        """Residual tables of the champion on one dataset."""
        rows = self.scored.where((F.col("model") == self.champion) & (F.col("variant") == self.variant)
                                 & (F.col("dataset") == dataset)).withColumn("residual", F.col("actual") - F.col("prediction"))
        return {"residuals": rm.residual_stats(rows), "histogram": rm.histogram(rows, "residual"),
                "box_plot": rm.box_plot(rows, "residual"), "percentiles": rm.error_percentiles(rows),
                "trend": rm.trend_lines(rows), "normal": rm.normal_fit(rm.normal_quantile_table(rows, "residual", [KEY]))}

    def predict(self, df: DataFrame) -> DataFrame:
        return apply_model(df, self.prepared.spec, self.model, "regression")

    def save(self, path: str) -> None:
        """Champion with its encoder, and the tables of the run: predictions of every model, metrics, decisions, ranking."""
        write_run(path, {"predictions": self.scored, "metrics": self.metrics, "decisions": self.decisions, "ranking": self.ranking,
                         "cross_validation": self.cross_validation, **{f"trials_{n}": t for n, t in self.trials.items()}})
        save_model(self.model, path, {"kind": "regression", "spec": asdict(self.prepared.spec), "champion": self.champion,
                                      "variant": self.variant, "features": self.prepared.features,
                                      "target_labels": list(self.coder.index.labels) if self.coder.index else None})
