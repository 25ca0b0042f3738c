"""Encoding, imputing, assembling and scaling; everything fitted is a pyspark.ml model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.columns import hash_code, is_missing, text_to_number
from loomwork.operators.rank import with_position
from loomwork.session import broadcast_if_small

#: Most values of a dictionary that is sent to the rows instead of being joined by shuffle.
SMALL_DICTIONARY = 100_000

# Fixed value: columns that are row numbers, never features of a clustering.
ROW_ID_COLUMNS = ["id", "index", "row_id", "row_number"]


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles carried between the steps of a run."""

    target: str | None
    categorical: list[str] = field(default_factory=list)
    hashed: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    impute: float = 0.0

    @property
    def raw(self) -> list[str]:
        return self.categorical + self.hashed + self.numeric

    @property
    def encoded(self) -> list[str]:
        return [f"{c}_encoded" for c in self.categorical] + self.hashed + self.numeric


def index_categories(df: DataFrame, columns: list[str]) -> StringIndexerModel:
    """One multi-column indexer for columns of few values, as a stage of a saved model; ``index_dictionary`` has no such bound.

    Most frequent value first, ties by value; unseen values get an extra index.
    """
    return StringIndexer(inputCols=columns, outputCols=[f"{c}_encoded" for c in columns], handleInvalid="keep",
                         stringOrderType="frequencyDesc").fit(df)


def index_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, index) of a column of any cardinality: most frequent value first, ties by value, from 0.

    Values are counted with map-side combine and numbered by a range sort; the dictionary stays a table.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_position(counts, [F.col("n").desc(), F.col("value")], "at").select("value", (F.col("at") - 1).cast("double").alias("index"))


def index_by_dictionary(df: DataFrame, column: str, dictionary: DataFrame, output: str, unseen: float | None = None) -> DataFrame:
    """``df`` with the index of a column; null and unseen values get ``unseen``. Small dictionaries are sent to the rows."""
    known = dictionary.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
    joined = df.join(broadcast_if_small(known, SMALL_DICTIONARY), F.col(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(output, F.coalesce("_index", F.lit(unseen).cast("double"))).drop("_value", "_index")


def index_target(df: DataFrame, target: str, output: str = "label") -> StringIndexerModel:
    return StringIndexer(inputCol=target, outputCol=output, handleInvalid="error").fit(df)


def impute_numeric(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Null and NaN replaced by a constant; the column type is kept."""
    def filled(c: str):
        t = df.schema[c].dataType
        return F.when(is_missing(c, t), F.lit(value).cast(t)).otherwise(F.col(c))
    return df.withColumns({c: filled(c) for c in columns})


def clean_numeric_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns listed as numeric but stored as text become doubles."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: text_to_number(F.col(c)) for c in text}) if text else df


def hash_columns(df: DataFrame, columns: list[str], positive: bool = False) -> DataFrame:
    return df.withColumns({c: hash_code(F.col(c), positive) for c in columns}) if columns else df


def prepare_columns(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Row-wise part of the preprocessing: hash codes, numeric text, imputation; target kept in the same row."""
    missing = [c for c in spec.raw if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the input: {missing}")
    df = hash_columns(clean_numeric_text(df, spec.numeric), spec.hashed)
    df = df.withColumns({c: F.col(c).cast("double") for c in spec.numeric}) if spec.numeric else df
    return impute_numeric(df, spec.numeric, spec.impute) if spec.numeric else df


def fit_encoder(df: DataFrame, spec: FeatureSpec, features: list[str] | None = None,
                scale: bool = True) -> PipelineModel:
    """Category indexer, assembler and scaler fitted together on ``df`` (usually train)."""
    features = features or spec.encoded
    stages = []
    if spec.categorical:
        stages.append(StringIndexer(inputCols=spec.categorical, outputCols=[f"{c}_encoded" for c in spec.categorical],
                                    handleInvalid="keep"))
    if scale:
        stages += [VectorAssembler(inputCols=features, outputCol="assembled", handleInvalid="keep"),
                   StandardScaler(inputCol="assembled", outputCol="features", withStd=True, withMean=False)]
    else:
        stages.append(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def standardised(train: DataFrame, others: dict[str, DataFrame], features: list[str]) -> dict[str, DataFrame]:
    """Scale by the standard deviation of train, no centring; the same model is applied to every frame."""
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="assembled"),
                             StandardScaler(inputCol="assembled", outputCol="features")]).fit(train)
    return {name: model.transform(df).drop("assembled") for name, df in {"train": train, **others}.items()}


def clustering_spec(df: DataFrame, impute: float = 0.0) -> FeatureSpec:
    """Roles for an unsupervised run: numeric and text columns, row-number columns left out."""
    usable = [f for f in df.schema if f.name.lower() not in ROW_ID_COLUMNS]
    return FeatureSpec(
        target=None,
        categorical=[f.name for f in usable if isinstance(f.dataType, T.StringType)],
        numeric=[f.name for f in usable if isinstance(f.dataType, T.NumericType)],
        impute=impute,
    )


def holdout_report(frames: dict[str, DataFrame], required: list[str], spark) -> DataFrame:
    """(dataset, usable, missing): whether every required column is present in each hold-out."""
    rows = []
    for name, df in frames.items():
        lost = [c for c in required if c not in df.columns]
        rows.append((name, not lost, ",".join(lost)))
    return spark.createDataFrame(rows, "dataset string, usable boolean, missing string")
