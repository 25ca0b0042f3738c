"""Writing results: predictions, clustered rows, metric tables, models, staged views."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, label: str = "label") -> None:
    """Label, prediction and probability as Parquet; the probability vector becomes an array."""
    cols = [F.col(label), F.col("prediction")]
    if "probability" in df.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    df.select(*cols).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A metrics or profile table as json, csv or parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def save_model(model: PipelineModel, path: str, info: dict) -> None:
    """Fitted model and its run information (one JSON row) side by side."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    text = json.dumps(info, sort_keys=True)
    spark.createDataFrame([(text,)], "info string").write.mode("overwrite").json(f"{path}/info")


def write_run(path: str, tables: dict[str, DataFrame | None]) -> None:
    """The result tables of a run as Parquet beside its model, one folder each; missing ones are left out."""
    for name, df in tables.items():
        if df is not None:
            write_table(df, f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    info = spark.read.schema("info string").json(f"{path}/info").first()["info"]
    return PipelineModel.load(f"{path}/model"), json.loads(info)


def stage_view(df: DataFrame, name: str) -> DataFrame:
    """Register a frame under a name for SQL."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def query_frame(df: DataFrame, sql: str) -> DataFrame:
    """Run SQL over a frame; the text refers to it as ``{df}``."""
    return df.sparkSession.sql(sql, df=df)
