"""Model-choice queries on metric tables computed from the data."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from loomwork.catalog.classification_queries import sql_auc, sql_decile
from loomwork.catalog.inputs import (LINE_KEY, SQL_MODEL_SCORES, SQL_REGRESSION_MODELS, model_scores, regression_models,
                                     rounded, table)
from loomwork.catalog.registry import query
from loomwork.catalog.regression_queries import _METRICS
from loomwork.operators import choose as ch
from loomwork.operators import classification_metrics as cm
from loomwork.operators import clustering_metrics as cu
from loomwork.operators import regression_metrics as rm
from loomwork.session import stage

DATASETS = ["train", "valid", "test", "oot1", "oot2"]

_MODEL_SQL = f"""(
WITH src AS MATERIALIZED (SELECT * FROM {SQL_MODEL_SCORES}),
a AS ({sql_auc('src', 'model, dataset')}),
k AS (SELECT model, dataset, max(spread) AS ks FROM ({sql_decile('src', 'model, dataset')}) GROUP BY 1, 2),
h AS (SELECT model, dataset, round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM src GROUP BY 1, 2)
SELECT model, dataset, 'roc' AS metric, roc AS value FROM a UNION ALL SELECT model, dataset, 'ks', ks FROM k
UNION ALL SELECT model, dataset, 'accuracy', accuracy FROM h)"""


def _metrics(spark, sf):
    out = cm.metric_matrix(model_scores(spark, sf), LINE_KEY, ["model", "dataset"])
    return stage(rounded(out, 6, "value"), "metrics")


def _sql_ranked(metric: str, dataset: str, limit: float, source: str, direction: str = "DESC") -> str:
    return f"""
WITH m AS MATERIALIZED (SELECT * FROM {source}), v AS (SELECT model, dataset, value FROM m WHERE metric = '{metric}'),
h AS (SELECT model, value AS score FROM v WHERE dataset = '{dataset}'),
c AS (SELECT h.model, score, count(*) FILTER (dataset <> '{dataset}' AND abs(score - value) > {limit}) AS s FROM h JOIN v USING (model) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY s, score {direction}, model) AS rank FROM c)
SELECT rank::INTEGER AS rank, model, '{metric}' AS metric, round(score, 4) AS score, s AS stability_score,
 CASE rank WHEN 1 THEN 'Champion' WHEN 2 THEN 'Challenger' ELSE '' END AS role FROM r"""


@query("sel4_choose_classifier", _sql_ranked("ks", "valid", 3.0, _MODEL_SQL))
def _(spark, sf):
    return rounded(ch.choose_classifier(_metrics(spark, sf), "ks", "valid", DATASETS), 4, "score")


@query("sel4_choose_classifier_fallback", _sql_ranked("accuracy", "valid", 0.03, _MODEL_SQL))
def _(spark, sf):
    return rounded(ch.choose_classifier(_metrics(spark, sf), "f1", "valid", DATASETS), 4, "score")


_REG_SQL = f"""(SELECT model, dataset, metric, round(value, 4) AS value FROM (
 SELECT model, dataset, {_METRICS} FROM {SQL_REGRESSION_MODELS} GROUP BY 1, 2) UNPIVOT (value FOR metric IN (rmse, mae, r2)))"""


def _reg_metrics(spark, sf):
    wide = rm.regression_metrics(regression_models(spark, sf), groups=["model", "dataset"])
    return stage(rounded(wide.unpivot(["model", "dataset"], ["rmse", "mae", "r2"], "metric", "value"), 4, "value"), "metrics")


@query("sel5_choose_regressor", _sql_ranked("rmse", "valid", 0.1, _REG_SQL, "ASC"))
def _(spark, sf):
    return rounded(ch.choose_regressor(_reg_metrics(spark, sf), "rmse", "valid", DATASETS), 4, "score")


@query("sel5_choose_regressor_r2", _sql_ranked("r2", "test", 0.02, _REG_SQL))
def _(spark, sf):
    return rounded(ch.choose_regressor(_reg_metrics(spark, sf), "r2", "test", DATASETS), 4, "score")


def _variants(df):
    """Pairs of score expressions stand for the default and the tuned variant of a model."""
    pair = F.when(F.col("model").isin("tax", "discount_tax"), "a").otherwise("b")
    return df.withColumn("variant", F.when(F.col("model").isin("tax", "full_price"), "default").otherwise("tuned")).withColumn("model", pair)


_SQL_VARIANTS = f"""(SELECT CASE WHEN model IN ('tax', 'discount_tax') THEN 'a' ELSE 'b' END AS model,
 CASE WHEN model IN ('tax', 'full_price') THEN 'default' ELSE 'tuned' END AS variant, dataset, metric, value FROM {_MODEL_SQL})"""


def _sql_decisions(metric: str, imp: float, over: float) -> str:
    return f"""
WITH w AS (SELECT model, max(value) FILTER (variant = 'default' AND dataset = 'valid') AS d, max(value) FILTER (variant = 'tuned' AND dataset = 'valid') AS t,
 max(value) FILTER (variant = 'default' AND dataset = 'train') AS dt, max(value) FILTER (variant = 'tuned' AND dataset = 'train') AS tt
 FROM {_SQL_VARIANTS} WHERE metric = '{metric}' GROUP BY 1),
g AS (SELECT model, d AS default_score, t AS tuned_score, coalesce((dt - d) / nullif(dt, 0), 0) AS default_overfitting,
 coalesce((tt - t) / nullif(tt, 0), 0) AS tuned_overfitting, coalesce((t - d) / nullif(abs(d), 0) * 100, 0) AS improvement_pct FROM w),
r AS (SELECT *, CASE WHEN tuned_score <= default_score THEN 'not better' WHEN improvement_pct < {imp * 100} THEN 'improvement below threshold'
 WHEN tuned_overfitting > default_overfitting + {over} THEN 'more overfitting' ELSE 'improved' END AS reason FROM g)
SELECT model, round(default_score, 6) AS default_score, round(tuned_score, 6) AS tuned_score, round(default_overfitting, 6) AS default_overfitting,
 round(tuned_overfitting, 6) AS tuned_overfitting, round(improvement_pct, 6) AS improvement_pct, reason,
 CASE WHEN reason = 'improved' THEN 'tuned' ELSE 'default' END AS decision FROM r"""


_NUMS = ["default_score", "tuned_score", "default_overfitting", "tuned_overfitting", "improvement_pct"]


@query("sel1_tuned_decisions", _sql_decisions("roc", 0.01, 0.05))
def _(spark, sf):
    return rounded(ch.tuned_decisions(_variants(_metrics(spark, sf)), "roc"), 6, *_NUMS)


@query("sel1_tuned_decisions_ks", _sql_decisions("ks", 0.01, 0.05))
def _(spark, sf):
    return rounded(ch.tuned_decisions(_variants(_metrics(spark, sf)), "ks"), 6, *_NUMS)


@query("sel2_overfitting_gap", f"""
SELECT model, metric, round(max(value) FILTER (dataset = 'train'), 6) AS train, round(max(value) FILTER (dataset = 'valid'), 6) AS valid,
 round(coalesce((max(value) FILTER (dataset = 'train') - max(value) FILTER (dataset = 'valid')) / nullif(max(value) FILTER (dataset = 'train'), 0), 0), 6) AS gap
FROM {_MODEL_SQL} GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(ch.gaps(_metrics(spark, sf)), 6, "train", "valid", "gap")


@query("sel7_stability", f"""
SELECT model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / avg(value), 6) AS cv, round(min(value), 6) AS min,
 round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range, count(*) AS datasets FROM {_MODEL_SQL} WHERE metric = 'ks' AND value > 0 GROUP BY 1""")
def _(spark, sf):
    return rounded(ch.stability(_metrics(spark, sf), "ks"), 6, "mean", "std", "cv", "min", "max", "range")


@query("sel8_compare_models", f"""SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
 round(max(value), 6) AS max FROM {_MODEL_SQL} GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(ch.compare_models(_metrics(spark, sf)), 6, "mean", "std", "min", "max")


@query("sel8_rank_models", f"""SELECT (row_number() OVER (ORDER BY value DESC, model))::INTEGER AS rank, model, round(value, 6) AS value
 FROM {_MODEL_SQL} WHERE metric = 'roc' AND dataset = 'test'""")
def _(spark, sf):
    return rounded(ch.rank_models(_metrics(spark, sf), "roc", "test"), 6, "value")


@query("sel9_run_summary", f"""
SELECT count(*) AS models, count(*) FILTER (decision = 'default') AS default_chosen, count(*) FILTER (decision = 'tuned') AS tuned_chosen,
 count(*) FILTER (reason = 'not better') AS not_better, count(*) FILTER (reason = 'improvement below threshold') AS below_threshold,
 count(*) FILTER (reason = 'more overfitting') AS more_overfitting, round(avg(improvement_pct), 4) AS avg_improvement_pct FROM ({_sql_decisions('roc', 0.01, 0.05)})""")
def _(spark, sf):
    return rounded(ch.run_summary(ch.tuned_decisions(_variants(_metrics(spark, sf)), "roc")), 4, "avg_improvement_pct")


def _sweep(spark, sf):
    """Indices of the clusterings ``p_size % k`` of part, k = 2..6."""
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice", "p_size")
    v = VectorAssembler(inputCols=["size", "p_retailprice"], outputCol="features").transform(t)
    parts = [cu.all_indices(v.withColumn("prediction", F.col("p_size") % k)).select(
        F.lit(k).alias("k"), "inertia", "silhouette", "calinski_harabasz", "davies_bouldin") for k in range(2, 7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stage(out, "sweep")


_SWEEP_SQL = """
WITH x AS (SELECT p_partkey, k, p_size % k AS c, p_size::DOUBLE AS a, p_retailprice AS b FROM part CROSS JOIN range(2, 7) r(k)),
m AS (SELECT k, c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, (var_pop(a) + var_pop(b)) * count(*) AS w FROM x GROUP BY 1, 2),
o AS (SELECT k, avg(a) AS ga, avg(b) AS gb FROM x GROUP BY 1),
i AS (SELECT m.k, sum(w) AS inertia, (sum(n * ((ma - ga) ** 2 + (mb - gb) ** 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS ch
      FROM m JOIN o ON m.k = o.k GROUP BY 1),
d AS (SELECT x.k, x.p_partkey, x.c AS mine, m.c, n, (a - ma) ** 2 + (b - mb) ** 2 AS d2, w FROM x JOIN m ON x.k = m.k),
f AS (SELECT k, p_partkey, max(CASE WHEN c = mine THEN (n * d2 + w) / (n - 1) END) AS ins, min(CASE WHEN c <> mine THEN d2 + w / n END) AS outs FROM d GROUP BY 1, 2),
s AS (SELECT k, avg((outs - ins) / greatest(outs, ins)) AS silhouette FROM f GROUP BY 1),
e AS (SELECT k, c, avg(sqrt(d2)) AS den FROM d WHERE c = mine GROUP BY 1, 2),
q AS (SELECT p.k, p.c, max((e1.den + e2.den) / sqrt((p.ma - r.ma) ** 2 + (p.mb - r.mb) ** 2)) AS r FROM m p JOIN m r ON p.k = r.k AND p.c <> r.c
      JOIN e e1 ON e1.k = p.k AND e1.c = p.c JOIN e e2 ON e2.k = r.k AND e2.c = r.c GROUP BY 1, 2),
z AS (SELECT k, avg(r) AS db FROM q GROUP BY 1),
t AS MATERIALIZED (SELECT i.k::INTEGER AS k, inertia, silhouette, ch AS calinski_harabasz, db AS davies_bouldin FROM i JOIN s USING (k) JOIN z USING (k)),
g AS (SELECT k, lead(inertia) OVER v - 2 * inertia + lag(inertia) OVER v AS bend FROM t WINDOW v AS (ORDER BY k))"""


@query("tun5_index_sweep", f"""{_SWEEP_SQL} SELECT k, round(inertia, 2) AS inertia, round(silhouette, 6) AS silhouette,
 round(calinski_harabasz, 6) AS calinski_harabasz, round(davies_bouldin, 4) AS davies_bouldin FROM t""")
def _(spark, sf):
    out = rounded(rounded(_sweep(spark, sf), 2, "inertia"), 6, "silhouette", "calinski_harabasz")
    return rounded(out, 4, "davies_bouldin")


@query("tun6_elbow", f"{_SWEEP_SQL} SELECT k, round(bend, 1) AS bend FROM g WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1")
def _(spark, sf):
    return rounded(ch.elbow(_sweep(spark, sf)), 1, "bend")


@query("tun7_recommended_k", f"""{_SWEEP_SQL}
(SELECT 'elbow' AS criterion, k FROM g WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1)
UNION ALL (SELECT 'silhouette', k FROM t WHERE silhouette > 0 ORDER BY silhouette DESC, k LIMIT 1)
UNION ALL (SELECT 'calinski_harabasz', k FROM t WHERE calinski_harabasz > 0 ORDER BY calinski_harabasz DESC, k LIMIT 1)
UNION ALL (SELECT 'davies_bouldin', k FROM t ORDER BY davies_bouldin, k LIMIT 1)""")
def _(spark, sf):
    return ch.recommend_k(_sweep(spark, sf))


def _cluster_metrics(spark, sf):
    """Three ways to cluster part, judged on parts of odd and even key as train and validation."""
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice", "p_size")
    v = VectorAssembler(inputCols=["size", "p_retailprice"], outputCol="features").transform(t)
    rows = []
    for model, k in (("mod2", 2), ("mod3", 3), ("mod5", 5)):
        for dataset, odd in (("train", 1), ("validation", 0)):
            part = v.where(F.col("p_partkey") % 2 == odd).withColumn("prediction", F.col("p_size") % k)
            s = cu.cluster_summary(part)
            db = cu.davies_bouldin(cu.centre_distances(s, cu.cluster_density(cu.with_centre_distances(part, s))))
            rows.append(db.select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), F.lit("davies_bouldin").alias("metric"),
                                  F.col("davies_bouldin").alias("value")))
            rows.append(cu.spread_indices(s).select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"),
                                                    F.lit("calinski_harabasz").alias("metric"), F.col("calinski_harabasz").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return stage(out, "metrics")


_CLUSTER_SQL = """
WITH x AS (SELECT k, p_size % k AS c, p_size::DOUBLE AS a, p_retailprice AS b, CASE WHEN p_partkey % 2 = 1 THEN 'train' ELSE 'validation' END AS dataset
 FROM part CROSS JOIN (VALUES (2), (3), (5)) r(k)),
m AS (SELECT k, dataset, c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, (var_pop(a) + var_pop(b)) * count(*) AS w FROM x GROUP BY 1, 2, 3),
o AS (SELECT k, dataset, avg(a) AS ga, avg(b) AS gb FROM x GROUP BY 1, 2),
i AS (SELECT m.k, m.dataset, (sum(n * ((ma - ga) ** 2 + (mb - gb) ** 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS value
      FROM m JOIN o ON m.k = o.k AND m.dataset = o.dataset GROUP BY 1, 2),
e AS (SELECT x.k, x.dataset, x.c, ma, mb, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) AS den FROM x JOIN m ON x.k = m.k AND x.dataset = m.dataset AND x.c = m.c GROUP BY 1, 2, 3, 4, 5),
q AS (SELECT p.k, p.dataset, p.c, max((p.den + r.den) / sqrt((p.ma - r.ma) ** 2 + (p.mb - r.mb) ** 2)) AS r FROM e p JOIN e r ON p.k = r.k AND p.dataset = r.dataset AND p.c <> r.c GROUP BY 1, 2, 3),
z AS (SELECT k, dataset, avg(r) AS value FROM q GROUP BY 1, 2)"""


@query("sel6_choose_clusterer", f"""{_CLUSTER_SQL}
SELECT 'mod' || k AS model, round(value, 4) AS score, dataset, (row_number() OVER (ORDER BY value, k))::INTEGER AS rank,
 row_number() OVER (ORDER BY value, k) = 1 AS selected FROM z WHERE dataset = 'validation'""")
def _(spark, sf):
    return rounded(ch.choose_clusterer(_cluster_metrics(spark, sf), "davies_bouldin"), 4, "score")


@query("sel6_choose_clusterer_by_ch", f"""{_CLUSTER_SQL}
SELECT 'mod' || k AS model, round(value, 6) AS score, dataset, (row_number() OVER (ORDER BY value DESC, k))::INTEGER AS rank,
 row_number() OVER (ORDER BY value DESC, k) = 1 AS selected FROM i WHERE dataset = 'validation'""")
def _(spark, sf):
    return rounded(ch.choose_clusterer(_cluster_metrics(spark, sf), "calinski_harabasz"), 6, "score")
