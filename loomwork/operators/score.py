"""Batch scoring from saved artefacts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.encode import FeatureSpec, prepare_columns
from loomwork.operators.regression_metrics import with_residuals
from loomwork.sources.sinks import load_model


def apply_model(df: DataFrame, spec: FeatureSpec, model, kind: str) -> DataFrame:
    """Preprocess, encode, scale and predict; the input columns are kept as they were.

    Prepared copies of the columns live only inside the model steps. Raises when a required column is missing.
    """
    raw = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    work = prepare_columns(df.select("*", raw), spec)
    out = model.transform(work)
    extra = [F.col("prediction")]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        extra.append(p.alias("probability"))
        if kind == "classification":
            extra.append(F.try_element_at(p, F.lit(2)).alias("positive_probability"))
    result = out.select("_row.*", *extra)
    return with_residuals(result) if kind == "regression" else result


def scored_rows(df: DataFrame, model, info: dict) -> DataFrame:
    """``df`` scored by a loaded run; every step works row by row, so ``df`` may also be a stream."""
    scored = apply_model(df, FeatureSpec(**info["spec"]), model, info["kind"])
    if info.get("labels"):
        labels = F.array(*[F.lit(v) for v in info["labels"]])
        scored = scored.withColumn("predicted_class", F.try_element_at(labels, F.col("prediction").cast("int") + 1))
    return scored


def score(path: str, df: DataFrame, output: str | None = None) -> DataFrame:
    """Load a saved run, score ``df`` and optionally write the result as Parquet."""
    model, info = load_model(df.sparkSession, path)
    scored = scored_rows(df, model, info)
    if output:
        scored.write.mode("overwrite").parquet(output)
        return df.sparkSession.read.parquet(output)
    return scored
