"""Classification run: prepare, fit models, judge them on every dataset, choose, predict, save."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import choose as ch
from loomwork.operators import classification_metrics as cm
from loomwork.operators import encode as en
from loomwork.operators import profile as pf
from loomwork.operators import tune as tn
from loomwork.operators.adaptive import SEARCHES
from loomwork.operators.models import available_models, estimator
from loomwork.operators.score import apply_model
from loomwork.operators.smote import smote, smote_vectors
from loomwork.operators.split import oversample, use_cross_validation
from loomwork.plans.supervised import KEY, Settings, feature_spec, prepare_rows
from loomwork.session import stage
from loomwork.sources.sinks import save_model, write_run


class ClassificationRun:
    """Automatic classification of a table.

    After ``fit``: ``metrics`` (model, variant, dataset, metric, value), ``unseen`` (hold-out rows of a class that the
    training rows do not have, by dataset; they are not judged), ``decisions`` (default or tuned),
    ``ranking`` (champion first), ``model`` (encoder and champion as one fitted model).
    """

    def __init__(self, **settings):
        self.settings = Settings(**settings)

    def fit(self, train: DataFrame, target: str, keys: list[str], holdouts: dict[str, DataFrame] | None = None):
        s = self.settings
        if s.sample_fraction < 1.0:
            train = train.sample(False, s.sample_fraction, s.seed)
        self.labels = None
        train = train.where(F.col(target).isNotNull())
        holdouts = dict(holdouts or {})
        indexer = en.index_target(train.select(F.col(target).cast("string").alias(target)), target)
        self.labels = list(indexer.labels)
        if isinstance(train.schema[target].dataType, pf.T.NumericType):
            # numeric classes keep their own order
            self.labels = sorted(self.labels, key=float)
        elif not isinstance(train.schema[target].dataType, pf.T.StringType):
            # false before true, dates in time
            self.labels = sorted(self.labels)
        codes = F.create_map(*[x for i, v in enumerate(self.labels) for x in (F.lit(v), F.lit(float(i)))])

        def labelled(df: DataFrame) -> DataFrame:
            return df.withColumn("label", F.try_element_at(codes, F.col(target).cast("string"))).where(F.col("label").isNotNull())

        self.unseen = {n: d.where(F.col(target).isNotNull() & F.try_element_at(codes, F.col(target).cast("string")).isNull()).count()
                       for n, d in holdouts.items() if target in d.columns}
        self.classes = len(self.labels)
        self.criterion = s.criterion or ("ks" if self.classes <= 2 else "accuracy")
        if self.classes > 2 and self.criterion in ("ks", "roc"):
            self.criterion = "accuracy"
        spec = feature_spec(train, target, keys, s)
        self.rows = train.count()
        self.prepared = prepare_rows(labelled(train), {n: labelled(d) if target in d.columns else d for n, d in holdouts.items()},
                                     target, keys, "classification", s, spec, self._rebalance())
        self.cross_validated = train.sparkSession.range(1).select(
            use_cross_validation(F.lit(self.rows), s.cross_validation, bool(holdouts), s.cross_validate_below).alias("cv")).first()["cv"]
        self._fit_models()
        return self

    def _rebalance(self):
        s = self.settings
        if not s.balance:
            return None

        def add_rows(base: DataFrame, spec: en.FeatureSpec) -> DataFrame:
            if not pf.imbalance(base, "label", s.imbalance_threshold).first()["imbalanced"]:
                return base
            if s.balance == "smote":
                return smote(base, "label", spec.encoded, [KEY], max_ratio=s.max_ratio, seed=s.seed)
            return oversample(base, "label", [KEY], s.max_ratio, s.seed)

        return add_rows

    def _balance_fold(self, width: int):
        """What cross-validation does to the rows to fit of each fold: the same balancing, judged on the fold's own classes."""
        s = self.settings
        if not s.balance:
            return None

        def add_rows(fitted: DataFrame) -> DataFrame:
            if not pf.imbalance(fitted, "label", s.imbalance_threshold).first()["imbalanced"]:
                return fitted
            if s.balance == "smote":
                return smote_vectors(fitted, "label", "features", [KEY], width, s.max_ratio, seed=s.seed)
            return oversample(fitted, "label", [KEY], s.max_ratio, s.seed)

        return add_rows

    def _fit_models(self) -> None:
        s, p = self.settings, self.prepared
        names = s.models or available_models("classification", self.classes)
        sizes = dict(features=len(p.features), classes=self.classes)
        self.fitted, scored, cv_rows, self.trials = {}, None, [], {}
        whole = p.rows.where(F.col("dataset").isin(*s.shares))
        folds = tn.fold_parts(whole, [KEY], s.folds, self._balance_fold(len(p.features))) if self.cross_validated else None
        for name in names:
            variants = {"default": {}}
            if s.tune:
                run = SEARCHES[s.tune]
                self.trials[name] = run("classification", name, p.train, p.dataset("valid"), n=s.trials, seed=s.seed, keys=[KEY], **sizes)
                variants["tuned"] = tn.best_params(self.trials[name])
            for variant, params in variants.items():
                model = estimator("classification", name, params, **sizes).fit(p.train)
                self.fitted[name, variant] = model
                out = model.transform(p.rows)
                part = out.select(
                    F.lit(name).alias("model"), F.lit(variant).alias("variant"), "dataset", KEY, "label", "prediction",
                    vector_to_array("probability")[1].alias("score"))
                scored = part if scored is None else scored.unionByName(part)
                if self.cross_validated:
                    cv = tn.cross_validate("classification", name, whole, [KEY], params=params, parts=folds, **sizes)
                    cv_rows.append(cv.select(F.lit(name).alias("model"), F.lit(variant).alias("variant"), "folds", "mean", "std"))
        scored = stage(scored, "scored")
        groups = ["model", "variant", "dataset"]
        if self.classes <= 2:
            table = cm.metric_matrix(scored, [KEY], groups)
        else:
            table = cm.multiclass_matrix(scored, groups)
        self.scored = scored
        self.metrics = stage(table, "metrics")
        self.cross_validation = None
        for r in cv_rows:
            self.cross_validation = r if self.cross_validation is None else self.cross_validation.unionByName(r)
        chosen = self.metrics.where("variant = 'default'")
        self.decisions = None
        if s.tune:
            self.decisions = stage(ch.tuned_decisions(self.metrics, self.criterion, "classification", s.dataset), "decisions")
            chosen = self.metrics.join(self.decisions.select("model", F.col("decision").alias("variant")), ["model", "variant"])
        datasets = [r["dataset"] for r in self.metrics.select("dataset").distinct().collect()]
        self.ranking = stage(ch.choose_classifier(chosen.drop("variant"), self.criterion, s.dataset, datasets), "ranking")
        self.champion = self.ranking.where("rank = 1").first()["model"]
        variant = "default"
        if self.decisions is not None:
            variant = self.decisions.where(F.col("model") == self.champion).first()["decision"]
        self.variant = variant
        self.model = PipelineModel(stages=[*p.encoder.stages, self.fitted[self.champion, variant]])

    def predict(self, df: DataFrame) -> DataFrame:
        """Input rows with prediction, probability and the predicted class."""
        out = apply_model(df, self.prepared.spec, self.model, "classification")
        labels = F.array(*[F.lit(v) for v in self.labels])
        return out.withColumn("predicted_class", F.try_element_at(labels, F.col("prediction").cast("int") + 1))

    def save(self, path: str) -> None:
        """Champion with its encoder, and the tables of the run: predictions of every model, metrics, decisions, ranking."""
        write_run(path, {"predictions": self.scored, "metrics": self.metrics, "decisions": self.decisions, "ranking": self.ranking,
                         "cross_validation": self.cross_validation, **{f"trials_{n}": t for n, t in self.trials.items()}})
        save_model(self.model, path, {"kind": "classification", "spec": asdict(self.prepared.spec), "labels": self.labels,
                                      "champion": self.champion, "variant": self.variant, "features": self.prepared.features})
