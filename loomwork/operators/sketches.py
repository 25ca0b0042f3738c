"""Profiles that are stored and merged, so that new data is profiled without reading the old data again.

The state of a batch has one row per column: exact counts, extremes and moments, a sketch of the distinct values and, for
numbers, a sketch of the quantiles. All columns are profiled in one pass. States are kept in a folder partitioned by batch;
writing a batch again replaces it, and a profile merges however many batches by adding counts and uniting sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.columns import is_missing

#: Log of the buckets of a distinct sketch: the standard error is 1.04 / sqrt(2 ** 14), 0.8 percent.
DISTINCT_BITS = 14
#: Size of a quantile sketch: ranks are off by less than half a percent of the rows.
QUANTILE_SIZE = 800
QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]

_STATE = ("column string, numeric boolean, rows bigint, missing bigint, low double, high double, mean double, spread double, letters bigint, longest bigint, "
          "distinct binary, quantiles binary")


def _column_state(name: str, dtype: T.DataType) -> Column:
    quoted = f"`{name.replace('`', '``')}`"
    there = F.when(~is_missing(quoted, dtype), F.col(quoted))
    if isinstance(dtype, (T.StringType, T.IntegerType, T.LongType, T.BinaryType)):
        value = there
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        value = F.when(there.isNotNull(), F.to_json(F.struct(there)))
    else:
        value = there.cast("string")
    number = there.cast("double") if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
    text = there if isinstance(dtype, T.StringType) else F.lit(None).cast("string")
    return F.struct(
        F.lit(name).alias("column"), F.lit(isinstance(dtype, T.NumericType)).alias("numeric"), F.count(F.lit(1)).alias("rows"),
        F.count_if(is_missing(quoted, dtype)).alias("missing"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"),
        (F.var_pop(number) * F.count(number)).alias("spread"), F.sum(F.length(text)).cast("bigint").alias("letters"),
        F.max(F.length(text)).cast("bigint").alias("longest"), F.hll_sketch_agg(value, F.lit(DISTINCT_BITS)).alias("distinct"),
        F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias("quantiles"))


def profile_state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The state of a table, one row per column, from one pass.

    Null, blank and NaN values are missing and enter nothing but the counts. Nested values count as different when their JSON
    text differs. An empty table has a state with no rows, which changes nothing when merged.
    """
    names = df.columns if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], _STATE)
    return df.agg(F.array(*[_column_state(c, df.schema[c].dataType) for c in names]).alias("s")).select(F.inline("s"))


def merged(states: DataFrame) -> DataFrame:
    """One state per column out of the states of several batches."""
    weight = F.col("rows") - F.col("missing")
    of_column = Window.partitionBy("column")  # one row per batch
    mean = F.try_divide(F.sum(F.col("mean") * weight).over(of_column), F.sum(F.when(F.col("mean").isNotNull(), weight)).over(of_column))
    return states.withColumn("_mean", mean).groupBy("column").agg(
        F.bool_and("numeric").alias("numeric"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.first("_mean").alias("mean"), F.sum(F.col("spread") + weight * (F.col("mean") - F.col("_mean")) ** 2).alias("spread"), F.sum("letters").alias("letters"),
        F.max("longest").alias("longest"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def described(state: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """What a state says: column, rows, missing, missing_share, distinct (estimate), low, high, mean, std, quantiles (estimates), mean_length, longest.

    Columns without numbers have nulls in place of extremes, moments and quantiles, columns without texts in place of lengths.
    """
    there, held = F.col("rows") - F.col("missing"), F.col("numeric") & (F.col("rows") > F.col("missing"))
    ranks = F.array(*[F.lit(float(q)) for q in quantiles or QUANTILES])
    return state.select(
        "column", "rows", "missing", F.try_divide("missing", "rows").alias("missing_share"), F.hll_sketch_estimate("distinct").alias("distinct"), "low", "high", "mean",
        F.when(held, F.sqrt(F.try_divide("spread", there))).alias("std"), F.when(held, F.kll_sketch_get_quantile_double("quantiles", ranks)).alias("quantiles"),
        F.try_divide("letters", there).alias("mean_length"), "longest")


def store_state(df: DataFrame, path: str, batch: str, columns: list[str] | None = None) -> None:
    """Profile a batch into the folder; a batch of that name is replaced, the others stay as they are."""
    state = profile_state(df, columns).withColumn("batch", F.lit(batch)).coalesce(1)
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_STATE}, batch string").parquet(path)


def stored_profile(spark: SparkSession, path: str, batches: list[str] | None = None, quantiles: list[float] | None = None) -> DataFrame:
    """Profile of the named batches, or of all, from the stored states alone."""
    states = stored_states(spark, path)
    return described(merged(states if batches is None else states.where(F.col("batch").isin(batches))), quantiles)


def columns_to_keep(profile: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Columns whose share of missing values is at most the threshold."""
    return profile.where(F.coalesce("missing_share", F.lit(0.0)) <= threshold).select("column")
