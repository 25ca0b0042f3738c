"""Inputs the catalog queries share, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _dataset(year):
    return (
        F.when(year <= 1997, "train").when(year == 1998, "valid").when(year == 1999, "test")
        .when(year == 2000, "oot1").otherwise("oot2")
    )


SQL_DATASET = ("CASE WHEN year(l_shipdate) <= 1997 THEN 'train' WHEN year(l_shipdate) = 1998 THEN 'valid' "
               "WHEN year(l_shipdate) = 1999 THEN 'test' WHEN year(l_shipdate) = 2000 THEN 'oot1' ELSE 'oot2' END")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a binary scored frame: label = returned, score from discount and tax."""
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"),
        _dataset(F.year("l_shipdate")).alias("dataset"),
    ).withColumn("prediction", F.when(F.col("score") > 0.25, 1).otherwise(0))


SQL_SCORED = f"""(SELECT *, CASE WHEN score > 0.25 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_discount * 5 + l_tax AS score, {SQL_DATASET} AS dataset
  FROM lineitem))"""
SQL_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Four score expressions ("models") on every lineitem row, long form."""
    base = table(spark, folder, "lineitem").select(
        *LINE_KEY, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        _dataset(F.year("l_shipdate")).alias("dataset"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("discount_tax"),
        (F.col("l_tax") * 10).alias("tax"),
        (F.col("l_quantity") / 50.0).alias("quantity"),
        (F.lit(1.0) - F.col("l_discount") * 9).alias("full_price"),
    )
    long = base.unpivot([*LINE_KEY, "label", "dataset"], ["discount_tax", "tax", "quantity", "full_price"],
                        "model", "score")
    return long.withColumn("prediction", F.when(F.col("score") > 0.5, 1).otherwise(0))


SQL_MODEL_SCORES = f"""(SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT {SQL_KEY}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, {SQL_DATASET} AS dataset, model,
         CASE model WHEN 'discount_tax' THEN l_discount * 5 + l_tax WHEN 'tax' THEN l_tax * 10
                    WHEN 'quantity' THEN l_quantity / 50.0 ELSE 1.0 - l_discount * 9 END AS score
  FROM lineitem CROSS JOIN (VALUES ('discount_tax'), ('tax'), ('quantity'), ('full_price')) m(model)))"""


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a regression frame: price predicted from quantity and tax."""
    return table(spark, folder, "lineitem").select(
        *LINE_KEY, F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 1500.0 + F.col("l_tax") * 1000.0).alias("prediction"),
        _dataset(F.year("l_shipdate")).alias("dataset"),
    ).withColumn("residual", F.col("actual") - F.col("prediction"))


SQL_PREDICTED = f"""(SELECT *, actual - prediction AS residual FROM (
  SELECT {SQL_KEY}, l_extendedprice AS actual, l_quantity * 1500.0::DOUBLE + l_tax * 1000.0::DOUBLE AS prediction,
         {SQL_DATASET} AS dataset FROM lineitem))"""


def regression_models(spark: SparkSession, folder: str) -> DataFrame:
    """Three price predictors on every lineitem row, long form."""
    base = predicted(spark, folder).withColumns({
        "by_quantity": F.col("prediction"),
        "flat": F.lit(38000.0),
        "blend": F.col("prediction") * 0.5 + 19000.0,
    })
    keys = [*LINE_KEY, "actual", "dataset"]
    return base.select(*keys, "by_quantity", "flat", "blend").unpivot(
        keys, ["by_quantity", "flat", "blend"], "model", "prediction")


SQL_REGRESSION_MODELS = f"""(SELECT {SQL_KEY}, actual, dataset, model,
   CASE model WHEN 'by_quantity' THEN prediction WHEN 'flat' THEN 38000.0::DOUBLE
              ELSE prediction * 0.5::DOUBLE + 19000.0::DOUBLE END AS prediction
   FROM {SQL_PREDICTED} CROSS JOIN (VALUES ('by_quantity'), ('flat'), ('blend')) m(model))"""


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
