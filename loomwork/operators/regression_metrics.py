"""Regression metrics and diagnostics over any frame with an actual and a predicted value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import correlation, normal_quantile
from loomwork.operators.rank import exact_quantiles, running_sums, with_group_position

# Fixed value: denominator that replaces a zero actual in relative errors.
ZERO_FLOOR = 1e-8


def drop_incomplete(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Rows whose actual and prediction are both numbers."""
    def known(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(known(actual) & known(prediction))


def incomplete_counts(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    def lost(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lost(actual)).alias("null_actual"),
        F.count_if(lost(prediction)).alias("null_prediction"),
        F.count_if(~lost(actual) & ~lost(prediction)).alias("valid_rows"),
    )


def relative_error(actual: Column, prediction: Column) -> Column:
    floor = F.when(actual == 0, F.lit(ZERO_FLOOR)).otherwise(actual)
    return F.abs((actual - prediction) / floor)


def regression_metrics(df: DataFrame, actual: str = "actual", prediction: str = "prediction",
                       groups: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2, mse, mape (percent) and explained variance in one pass."""
    y, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    e = y - p
    clean = drop_incomplete(df, actual, prediction)
    return clean.groupBy(*(groups or [])).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(e * e).alias("mse"),
        (F.avg(relative_error(y, p)) * 100).alias("mape"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
    )


def residual_stats(df: DataFrame, residual: str = "residual", groups: list[str] | None = None) -> DataFrame:
    """Population moments of the residual: mean, std, skewness, excess kurtosis, min, max."""
    return df.groupBy(*(groups or [])).agg(
        F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"),
        F.skewness(residual).alias("skewness"), F.kurtosis(residual).alias("kurtosis"),
        F.min(residual).alias("min"), F.max(residual).alias("max"),
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between minimum and maximum; empty bins are listed with count 0."""
    limits = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("m")).scalar()
    width = (F.col("_m.hi") - F.col("_m.lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide(F.col(value).cast("double") - F.col("_m.lo"), width))
    slot = F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = df.where(F.col(value).isNotNull()).withColumn("_m", limits).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").withColumn("_m", limits).select(
        "bin",
        (F.col("_m.lo") + F.col("bin") * width).alias("lower"),
        (F.col("_m.lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def box_plot(df: DataFrame, value: str) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 interquartile ranges of the box)."""
    q = exact_quantiles(df, [], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    box = q.select(F.struct("*").alias("b")).scalar()
    v, spread = F.col(value), 1.5 * (F.col("_b.q3") - F.col("_b.q1"))
    low, high = F.col("_b.q1") - spread, F.col("_b.q3") + spread
    return df.where(v.isNotNull()).withColumn("_b", box).agg(
        F.first("_b.q1").alias("q1"), F.first("_b.median").alias("median"), F.first("_b.q3").alias("q3"),
        F.min(F.when(v >= low, v)).alias("whisker_low"),
        F.max(F.when(v <= high, v)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("outliers"),
    )


def normal_quantile_table(df: DataFrame, value: str, tie_break: list[str]) -> DataFrame:
    """Every value with its rank and two normal quantiles for that rank.

    ``theoretical`` uses Filliben plotting positions (the plotted line), ``theoretical_trimmed`` an even grid
    from 0.01 to 0.99 (the Q-Q R squared).
    """
    placed = with_group_position(df.select(value, *tie_break), [], [F.col(value).asc()] + [F.col(t) for t in tie_break])
    n, i = F.col("n").cast("double"), F.col("rn")
    edge = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == 1, 1.0 - edge).when(i == F.col("n"), edge).otherwise((i - 0.3175) / (n + 0.365))
    grid = 0.01 + 0.98 * F.coalesce(F.try_divide(i - 1.0, n - 1.0), F.lit(0.0))
    return placed.select(*tie_break, "rn", F.col(value).alias("sample"), normal_quantile(p).alias("theoretical"),
                         normal_quantile(grid).alias("theoretical_trimmed"))


def normal_fit(table: DataFrame) -> DataFrame:
    """Straight line through a quantile table and the Q-Q R squared."""
    return table.agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.pow(correlation(F.col("sample"), F.col("theoretical_trimmed")), 2).alias("qq_r2"),
        F.count(F.lit(1)).alias("n"),
    )


def error_percentiles(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Mean, median, max and upper percentiles of absolute error; mean and median relative error in percent."""
    y, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    errors = drop_incomplete(df, actual, prediction).select(
        F.abs(y - p).alias("absolute"), (relative_error(y, p) * 100).alias("relative"))
    both = errors.unpivot([], ["absolute", "relative"], "kind", "error")
    q = exact_quantiles(both, ["kind"], "error", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    plain = both.groupBy("kind").agg(F.avg("error").alias("mean"), F.max("error").alias("max"))
    wide = plain.join(q, "kind")

    def pick(kind: str, c: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(c)))

    return wide.agg(
        pick("absolute", "mean").alias("mean_abs"), pick("absolute", "median").alias("median_abs"),
        pick("absolute", "max").alias("max_abs"), pick("absolute", "p90").alias("p90_abs"),
        pick("absolute", "p95").alias("p95_abs"), pick("absolute", "p99").alias("p99_abs"),
        pick("relative", "mean").alias("mean_rel_pct"), pick("relative", "median").alias("median_rel_pct"),
    )


def cumulative_distribution(df: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below every distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    return running_sums(counts, [], [F.col(value)], ["rows"]).select(
        value, F.col("rows_cum").alias("rows_upto"), (F.col("rows_cum") / F.col("rows_total")).alias("share"))


def trend_lines(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Least-squares lines actual -> predicted and predicted -> residual, and their squared correlation."""
    y, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    e = y - p
    return df.agg(
        F.regr_slope(p, y).alias("fit_slope"), F.regr_intercept(p, y).alias("fit_intercept"),
        F.pow(correlation(y, p), 2).alias("fit_r2"),
        F.regr_slope(e, p).alias("residual_slope"), F.regr_intercept(e, p).alias("residual_intercept"),
    )


def with_residuals(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Residual and absolute error when the frame carries ``actual`` or ``label``; unchanged otherwise."""
    for name in ("actual", "label"):
        if name in df.columns:
            e = F.col(prediction) - F.col(name).cast("double")
            return df.withColumn("residual", e).withColumn("absolute_error", F.abs(e))
    return df
