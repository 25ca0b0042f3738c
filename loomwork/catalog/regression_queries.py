"""Regression metric queries."""

from pyspark.sql import functions as F

from loomwork.catalog.inputs import LINE_KEY, SQL_KEY, SQL_PREDICTED, predicted, rounded, table
from loomwork.catalog.registry import query
from loomwork.operators import regression_metrics as rm

_METRICS = """sqrt(avg((actual - prediction) ** 2)) AS rmse, avg(abs(actual - prediction)) AS mae,
 1 - avg((actual - prediction) ** 2) / nullif(var_pop(actual), 0) AS r2, avg((actual - prediction) ** 2) AS mse,
 avg(abs((actual - prediction) / CASE WHEN actual = 0 THEN 1e-8 ELSE actual END)) * 100 AS mape,
 1 - var_pop(actual - prediction) / nullif(var_pop(actual), 0) AS explained_variance"""
_R = "round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, round(mse, 0) AS mse, round(mape, 5) AS mape, round(explained_variance, 6) AS explained_variance"


def _round_metrics(df):
    df = rounded(df, 4, "rmse", "mae")
    df = rounded(df, 0, "mse")
    return rounded(rounded(df, 5, "mape"), 6, "r2", "explained_variance")


@query("rgm1_rmse_mae_r2_mse", f"SELECT {_R} FROM (SELECT {_METRICS} FROM {SQL_PREDICTED})")
def _(spark, sf):
    return _round_metrics(rm.regression_metrics(predicted(spark, sf)))


@query("rgm1_metrics_by_dataset", f"SELECT dataset, {_R} FROM (SELECT dataset, {_METRICS} FROM {SQL_PREDICTED} GROUP BY dataset)")
def _(spark, sf):
    return _round_metrics(rm.regression_metrics(predicted(spark, sf), groups=["dataset"]))


@query("rgm2_mape_zero_actuals", """SELECT round(avg(abs((l_tax - l_discount) / CASE WHEN l_tax = 0 THEN 1e-8 ELSE l_tax END)) * 100, 0) AS mape
 FROM lineitem""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_tax").alias("actual"), F.col("l_discount").alias("prediction"))
    return rounded(rm.regression_metrics(t).select("mape"), 0, "mape")


@query("rgm3_explained_variance", f"SELECT round(1 - var_pop(actual - prediction) / nullif(var_pop(actual), 0), 6) AS explained_variance FROM {SQL_PREDICTED}")
def _(spark, sf):
    return rounded(rm.regression_metrics(predicted(spark, sf)).select("explained_variance"), 6, "explained_variance")


@query("rgm4_residual_stats", f"""
WITH m AS (SELECT avg(residual) AS mu, stddev_pop(residual) AS sd, min(residual) AS lo, max(residual) AS hi FROM {SQL_PREDICTED})
SELECT round(mu, 4) AS mean, round(sd, 4) AS std, round(avg(((residual - mu) / sd) ** 3), 6) AS skewness,
       round(avg(((residual - mu) / sd) ** 4) - 3, 6) AS kurtosis, lo AS min, hi AS max
FROM {SQL_PREDICTED}, m GROUP BY mu, sd, lo, hi""")
def _(spark, sf):
    out = rounded(rm.residual_stats(predicted(spark, sf)), 4, "mean", "std")
    return rounded(out, 6, "skewness", "kurtosis")


def _sql_hist(expr: str) -> str:
    return f"""
WITH v AS (SELECT {expr} AS v FROM {SQL_PREDICTED}), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT least(floor((v - lo) / ((hi - lo) / 30.0::DOUBLE)), 29)::INTEGER AS bin, count(*) AS n FROM v, m GROUP BY 1)
SELECT g.bin::INTEGER AS bin, round(lo + g.bin * ((hi - lo) / 30.0::DOUBLE), 4) AS lower,
       round(lo + (g.bin + 1) * ((hi - lo) / 30.0::DOUBLE), 4) AS upper, coalesce(n, 0) AS n
FROM range(30) g(bin) CROSS JOIN m LEFT JOIN b ON g.bin = b.bin"""


@query("rgm5_residual_histogram", _sql_hist("residual"))
def _(spark, sf):
    return rounded(rm.histogram(predicted(spark, sf), "residual"), 4, "lower", "upper")


@query("rgm5_absolute_error_histogram", _sql_hist("abs(residual)"))
def _(spark, sf):
    v = predicted(spark, sf).select(F.abs("residual").alias("v"))
    return rounded(rm.histogram(v, "v"), 4, "lower", "upper")


@query("rgm5_relative_error_histogram", _sql_hist("abs(residual / CASE WHEN actual = 0 THEN 1e-8 ELSE actual END)"))
def _(spark, sf):
    v = predicted(spark, sf).select(rm.relative_error(F.col("actual"), F.col("prediction")).alias("v"))
    return rounded(rm.histogram(v, "v"), 4, "lower", "upper")


@query("rgm6_box_plot", f"""
WITH v AS (SELECT residual AS v FROM {SQL_PREDICTED}),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v)
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
       round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
       count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM v, q GROUP BY q1, median, q3""")
def _(spark, sf):
    return rounded(rm.box_plot(predicted(spark, sf), "residual"), 4, "q1", "median", "q3", "whisker_low", "whisker_high")


def _horner(x: str, cs: list[float]) -> str:
    out = f"({cs[0]!r})"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def sql_ppf(p: str) -> str:
    from loomwork.functions.columns import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW
    r, c = f"(({p} - 0.5) * ({p} - 0.5))", f"({p} - 0.5)"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1.0 - {p}))"
    return f"""CASE WHEN {p} < {PPF_LOW} THEN {_horner(lo, PPF_C)} / {_horner(lo, PPF_D)}
 WHEN {p} > 1.0 - {PPF_LOW} THEN -{_horner(hi, PPF_C)} / {_horner(hi, PPF_D)}
 ELSE {_horner(r, PPF_A)} * {c} / {_horner(r, PPF_B)} END"""


_QQ = f"""
SELECT {SQL_KEY}, rn, sample, {sql_ppf('p')} AS theoretical, {sql_ppf('g')} AS theoretical_trimmed FROM (
 SELECT *, CASE WHEN rn = 1 THEN 1.0 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN rn = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n)
    ELSE (rn - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p, 0.01::DOUBLE + 0.98::DOUBLE * ((rn - 1.0::DOUBLE) / (n - 1.0::DOUBLE)) AS g
 FROM (SELECT {SQL_KEY}, residual AS sample, row_number() OVER (ORDER BY residual, {SQL_KEY}) AS rn, count(*) OVER () AS n
       FROM {SQL_PREDICTED}))"""


@query("rgm8_normal_quantile_table", f"""SELECT {SQL_KEY}, rn, round(sample, 4) AS sample, round(theoretical, 6) AS theoretical,
 round(theoretical_trimmed, 6) AS theoretical_trimmed FROM ({_QQ})""")
def _(spark, sf):
    out = rm.normal_quantile_table(predicted(spark, sf), "residual", LINE_KEY)
    return rounded(rounded(out, 4, "sample"), 6, "theoretical", "theoretical_trimmed")


@query("rgm8_normal_fit", f"""SELECT round(regr_slope(sample, theoretical), 3) AS slope, round(regr_intercept(sample, theoretical), 3) AS intercept,
 round(pow(corr(sample, theoretical_trimmed), 2), 6) AS qq_r2, count(*) AS n FROM ({_QQ})""")
def _(spark, sf):
    out = rm.normal_fit(rm.normal_quantile_table(predicted(spark, sf), "residual", LINE_KEY))
    return rounded(rounded(out, 3, "slope", "intercept"), 6, "qq_r2")


@query("rgm9_error_percentiles", f"""
WITH e AS (SELECT abs(residual) AS a, abs(residual / CASE WHEN actual = 0 THEN 1e-8 ELSE actual END) * 100 AS r FROM {SQL_PREDICTED})
SELECT round(avg(a), 4) AS mean_abs, round(quantile_cont(a, 0.5), 4) AS median_abs, round(max(a), 4) AS max_abs,
 round(quantile_cont(a, 0.9), 4) AS p90_abs, round(quantile_cont(a, 0.95), 4) AS p95_abs, round(quantile_cont(a, 0.99), 4) AS p99_abs,
 round(avg(r), 4) AS mean_rel_pct, round(quantile_cont(r, 0.5), 4) AS median_rel_pct FROM e""")
def _(spark, sf):
    out = rm.error_percentiles(predicted(spark, sf))
    return rounded(out, 4, *out.columns)


@query("rgm10_cumulative_error", f"""
SELECT DISTINCT round(v, 6) AS v, rank AS rows_upto, round(rank::DOUBLE / n, 6) AS share FROM (
 SELECT v, count(*) OVER (ORDER BY v) AS rank, count(*) OVER () AS n FROM (SELECT abs(residual) AS v FROM {SQL_PREDICTED}))""")
def _(spark, sf):
    out = rm.cumulative_distribution(predicted(spark, sf).select(F.abs("residual").alias("v")), "v")
    return rounded(out, 6, "v", "share")


@query("rgm11_trend_lines", f"""SELECT round(regr_slope(prediction, actual), 6) AS fit_slope,
 round(regr_intercept(prediction, actual), 3) AS fit_intercept, round(pow(corr(actual, prediction), 2), 6) AS fit_r2,
 round(regr_slope(residual, prediction), 6) AS residual_slope, round(regr_intercept(residual, prediction), 3) AS residual_intercept
 FROM {SQL_PREDICTED}""")
def _(spark, sf):
    out = rm.trend_lines(predicted(spark, sf))
    return rounded(rounded(out, 6, "fit_slope", "fit_r2", "residual_slope"), 3, "fit_intercept", "residual_intercept")
