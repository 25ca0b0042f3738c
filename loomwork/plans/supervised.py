"""Steps shared by the classification and the regression run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import encode as en
from loomwork.operators import features as fs
from loomwork.operators import profile as pf
from loomwork.operators.split import SMALL_FOR_SPLIT, assign_split
from loomwork.session import evenly, stage

KEY = "_key"


@dataclass
class Settings:
    """Arguments of a run with their defaults."""

    models: list[str] | None = None
    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.4, "valid": 0.3, "test": 0.3})
    seed: int = 42
    impute: float = 0.0
    missing_threshold: float = 0.7
    max_categories: int = 50
    max_features: int = 30
    importance_threshold: float = 0.01
    sample_fraction: float = 1.0
    criterion: str | None = None
    dataset: str = "valid"
    cross_validation: str = "never"
    folds: int = 5
    tune: str | None = None
    trials: int = 4
    balance: str | None = None
    max_ratio: float = 0.3
    imbalance_threshold: float = 0.05
    name_rules: dict = field(default_factory=dict)
    #: "forest", "statistical" or "sequential"; applied when there are more than ``max_features`` columns.
    selection: str = "forest"
    max_fit_rows: int | None = None
    #: For ``cross_validation="auto"``: fewer training rows than this ask for it.
    cross_validate_below: int = SMALL_FOR_SPLIT
    max_encoded: int = 200
    #: Share of unparsable values above which a text target of a regression is indexed.
    most_lost_targets: float = 0.5


def with_key(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """One text key per row; without key columns the whole row is the key, so equal rows share a split."""
    cols = keys or df.columns
    text = [F.col(c).cast("string") for c in cols]
    return df.withColumn(KEY, F.coalesce(text[0], F.lit("")) if len(cols) == 1 else F.to_json(F.array(*text)))


def feature_spec(df: DataFrame, target: str, keys: list[str], settings: Settings) -> en.FeatureSpec:
    """Column roles of the training table: names, dates, missing values and cardinality decide."""
    names = pf.feature_names([c for c in df.columns if c not in keys], target, **settings.name_rules)
    names = pf.drop_date_columns(df, names)
    kept = {r["column"] for r in pf.columns_below_missing(df.select(*names), settings.missing_threshold).collect()}
    names = [c for c in names if c in kept]
    text, numeric = pf.variable_types(df, names)
    wide: set[str] = set()
    if text:
        roles = pf.cardinality_roles(df, text, settings.max_categories, settings.max_encoded).collect()
        wide = {r["column"] for r in roles if r["role"] == "numeric"}
        unfit = {r["column"] for r in roles if r["role"] == "categorical" and not r["encodable"]}
        text = [c for c in text if c not in unfit]
    return en.FeatureSpec(target, [c for c in text if c not in wide], [c for c in text if c in wide], numeric, settings.impute)


@dataclass
class Prepared:
    """Encoded rows of all datasets, tagged; written once and read by every fit."""

    spec: en.FeatureSpec
    encoder: PipelineModel
    features: list[str]
    rows: DataFrame
    train: DataFrame
    holdout_report: DataFrame | None

    def dataset(self, name: str) -> DataFrame:
        return self.rows.where(F.col("dataset") == name)


def narrow_features(ready: DataFrame, spec: en.FeatureSpec, label: str, kind: str, settings: Settings) -> list[str]:
    """Features kept for modelling: all of them unless there are more than asked for."""
    names = spec.encoded
    if len(names) <= settings.max_features:
        return names
    coded = ready
    if spec.categorical:
        coded = en.index_categories(ready, spec.categorical).transform(ready)
    if settings.selection == "statistical":
        return [r["feature"] for r in fs.statistical_filter(coded, names, label, settings.max_features).collect()]
    if settings.selection == "sequential":
        return fs.sequential_selection(coded, names, label, settings.max_features, kind)
    if settings.selection != "forest":
        raise ValueError(f"selection is forest, statistical or sequential, not {settings.selection}")
    return fs.select_features(coded, names, label, settings.max_features, kind, settings.importance_threshold,
                              settings.max_fit_rows if kind == "classification" else None)


def prepare_rows(train: DataFrame, holdouts: dict[str, DataFrame], target: str, keys: list[str], kind: str,
                 settings: Settings, spec: en.FeatureSpec, rebalance=None) -> Prepared:
    """Split, balance, encode and scale; hold-outs without the needed columns are reported and left out.

    Encoder and scaler are fitted on the training part only. ``rebalance`` may add rows to what is fitted;
    metrics always use the rows as they came.
    """
    spark = train.sparkSession
    tagged = assign_split(with_key(train, keys), [KEY], settings.shares, settings.seed)
    report = en.holdout_report(holdouts, [target, *spec.raw], spark) if holdouts else None
    usable = {r["dataset"] for r in report.where("usable").collect()} if report is not None else set()
    cols = [KEY, "dataset", "label", *spec.raw]
    frames = [tagged.select(*cols)]
    for name in sorted(usable):
        frames.append(with_key(holdouts[name], keys).withColumn("dataset", F.lit(name)).select(*cols))
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    ready = stage(evenly(en.prepare_columns(whole, spec), KEY), "prepared")
    base = ready.where(F.col("dataset") == "train")
    names = narrow_features(base, spec, "label", kind, settings)
    used = en.FeatureSpec(target, [c for c in spec.categorical if f"{c}_encoded" in names],
                          [c for c in spec.hashed if c in names], [c for c in spec.numeric if c in names], spec.impute)
    cols = [KEY, "dataset", "label", "features"]
    if rebalance is None:
        encoder = en.fit_encoder(base, used)
    else:
        # rows are added after indexing, so synthetic rows can be formed over the encoded categories too
        index = [en.index_categories(base, used.categorical)] if used.categorical else []
        coded = index[0].transform(base) if index else base
        balanced = stage(rebalance(coded, used), "balanced")
        scale = en.fit_encoder(balanced, en.FeatureSpec(target, numeric=used.encoded))
        encoder = PipelineModel(stages=[*index, *scale.stages])
    rows = stage(encoder.transform(ready).select(*cols), "encoded")
    train_rows = rows.where("dataset = 'train'")
    if rebalance is not None:
        train_rows = stage(scale.transform(balanced).select(*cols), "balanced_rows")
    return Prepared(used, encoder, used.encoded, rows, train_rows, report)
