"""Classification metric and window queries."""

from pyspark.sql import functions as F

from loomwork.catalog.inputs import (LINE_KEY, SQL_KEY, SQL_MODEL_SCORES, SQL_SCORED, model_scores, rounded,
                                     scored)
from loomwork.catalog.registry import query
from loomwork.operators import classification_metrics as cm
from loomwork.operators.rank import with_ntile, with_position

DATASETS = ["train", "valid", "test", "oot1", "oot2"]
_ORDER = f"score DESC, {SQL_KEY}"


def sql_decile(source: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups}" if groups else ""
    g = f"{groups}, " if groups else ""
    return f"""
WITH t AS (SELECT {g}label, ntile(10) OVER ({part} ORDER BY {_ORDER}) AS decile FROM {source}),
d AS (SELECT {g}decile, count(*) AS cnt, sum(label) AS target, sum(1 - label) AS non_target
      FROM t GROUP BY {g}decile),
c AS (SELECT *, sum(target) OVER ({part} ORDER BY decile) AS ct, sum(non_target) OVER ({part} ORDER BY decile) AS cn,
             sum(target) OVER ({part}) AS tt, sum(non_target) OVER ({part}) AS tn FROM d)
SELECT {g}decile::INTEGER AS decile, cnt AS "count", target::BIGINT AS target, non_target::BIGINT AS non_target,
       ct::BIGINT AS cum_target, cn::BIGINT AS cum_non_target,
       round(target::DOUBLE / cnt * 100, 2) AS "Pct_target",
       round(ct::DOUBLE / nullif(tt, 0) * 100, 2) AS "%Dist_Target",
       round(cn::DOUBLE / nullif(tn, 0) * 100, 2) AS "%Dist_non_Target",
       round(abs(ct::DOUBLE / nullif(tt, 0) - cn::DOUBLE / nullif(tn, 0)) * 100, 2) AS spread FROM c"""


def sql_auc(source: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups}" if groups else ""
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""
SELECT {g}round(sum(p * (nb + n / 2.0)) / nullif(sum(p)::DOUBLE * sum(n), 0), 6) AS roc FROM (
  SELECT *, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM (SELECT {g}score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM {source} GROUP BY {g}score)) {by}"""


@query("clm1_accuracy", f"SELECT round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM {SQL_SCORED}")
def _(spark, sf):
    return rounded(cm.accuracy(scored(spark, sf)), 6, "accuracy")


@query("clm2_area_under_roc", sql_auc(SQL_SCORED))
def _(spark, sf):
    return rounded(cm.area_under_roc(scored(spark, sf)), 6, "roc")


@query("clm2_area_under_roc_grouped", sql_auc(SQL_MODEL_SCORES, "model, dataset"))
def _(spark, sf):
    return rounded(cm.area_under_roc(model_scores(spark, sf), groups=["model", "dataset"]), 6, "roc")


@query("clm3_area_under_pr", f"""
WITH s AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM {SQL_SCORED} GROUP BY score),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp FROM s
      WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT cp / tp AS rec, cp / (cp + cn) AS prec,
             lag(cp / tp, 1, 0.0) OVER (ORDER BY score DESC) AS rec0,
             lag(cp / (cp + cn), 1, cp / (cp + cn)) OVER (ORDER BY score DESC) AS prec0 FROM c)
SELECT round(sum((rec - rec0) * (prec + prec0) / 2), 6) AS pr FROM r""")
def _(spark, sf):
    return rounded(cm.area_under_pr(scored(spark, sf)), 6, "pr")


@query("clm4_decile_table", sql_decile(SQL_SCORED))
def _(spark, sf):
    return cm.decile_table(scored(spark, sf), LINE_KEY)


@query("clm4_decile_table_by_dataset", sql_decile(SQL_SCORED, "dataset"))
def _(spark, sf):
    return cm.decile_table(scored(spark, sf), LINE_KEY, groups=["dataset"])


@query("clm5_ks", f"SELECT max(spread) AS ks FROM ({sql_decile(SQL_SCORED)})")
def _(spark, sf):
    return cm.ks_statistic(cm.decile_table(scored(spark, sf), LINE_KEY))


_PRIORITY = """(SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS label, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1
 WHEN o_totalprice < 300000 THEN 2 WHEN o_totalprice < 400000 THEN 3 ELSE 4 END AS prediction FROM orders)"""


def _priorities(spark, sf):
    from loomwork.catalog.inputs import table
    p, v = F.col("o_orderpriority"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2)
        .when(p == "4-NOT SPECIFIED", 3).otherwise(4).alias("label"),
        F.when(v < 100000, 0).when(v < 200000, 1).when(v < 300000, 2).when(v < 400000, 3).otherwise(4)
        .alias("prediction"))


@query("clm6_weighted_multiclass", f"""
WITH x AS (SELECT * FROM {_PRIORITY}), k AS (SELECT label AS c FROM x UNION SELECT prediction FROM x),
s AS (SELECT c, (SELECT count(*) FROM x WHERE label = c)::DOUBLE AS a, (SELECT count(*) FROM x WHERE prediction = c)::DOUBLE AS q,
             (SELECT count(*) FROM x WHERE label = c AND prediction = c)::DOUBLE AS h FROM k),
m AS (SELECT a, h, coalesce(h / nullif(q, 0), 0) AS p, coalesce(h / nullif(a, 0), 0) AS r FROM s)
SELECT round(sum(h) / sum(a), 6) AS accuracy, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * a) / sum(a), 6) AS f1,
       round(sum(p * a) / sum(a), 6) AS precision, round(sum(r * a) / sum(a), 6) AS recall FROM m""")
def _(spark, sf):
    return rounded(cm.weighted_metrics(_priorities(spark, sf)), 6, "accuracy", "f1", "precision", "recall")


@query("clm7_confusion_counts", f"SELECT label, prediction, count(*) AS n FROM {_PRIORITY} GROUP BY 1, 2")
def _(spark, sf):
    return cm.confusion_counts(_priorities(spark, sf))


@query("clm7_confusion_matrix", f"""SELECT label, count(*) FILTER (prediction = 0) AS p0, count(*) FILTER (prediction = 1) AS p1,
 count(*) FILTER (prediction = 2) AS p2, count(*) FILTER (prediction = 3) AS p3, count(*) FILTER (prediction = 4) AS p4
 FROM {_PRIORITY} GROUP BY label""")
def _(spark, sf):
    wide = cm.confusion_counts(_priorities(spark, sf)).groupBy("label").pivot("prediction", [0, 1, 2, 3, 4]).sum("n")
    return wide.na.fill(0).toDF("label", "p0", "p1", "p2", "p3", "p4")


@query("clm8_roc_points", f"""
WITH s AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM {SQL_SCORED} GROUP BY score)
SELECT score AS threshold, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr
FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return rounded(cm.roc_points(scored(spark, sf)), 6, "fpr", "tpr")


@query("clm9_metric_matrix", f"""
WITH a AS ({sql_auc(SQL_MODEL_SCORES, 'model, dataset')}),
k AS (SELECT model, dataset, max(spread) AS ks FROM ({sql_decile(SQL_MODEL_SCORES, 'model, dataset')}) GROUP BY 1, 2),
h AS (SELECT model, dataset, round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
      FROM {SQL_MODEL_SCORES} GROUP BY 1, 2),
l AS (SELECT model, dataset, 'roc' AS metric, roc AS value FROM a UNION ALL SELECT model, dataset, 'ks', ks FROM k
      UNION ALL SELECT model, dataset, 'accuracy', accuracy FROM h),
w AS (SELECT * FROM (SELECT DISTINCT model, metric FROM l)
      CROSS JOIN (VALUES ('train'), ('valid'), ('test'), ('oot1'), ('oot2'), ('oot3')) d(dataset))
SELECT model, dataset, metric, coalesce(value, 0.0) AS value FROM w LEFT JOIN l USING (model, dataset, metric)""")
def _(spark, sf):
    out = cm.metric_matrix(model_scores(spark, sf), LINE_KEY, ["model", "dataset"], DATASETS + ["oot3"])
    return rounded(out, 6, "value")


@query("clm9_multiclass_matrix", f"""
WITH x AS (SELECT dataset, label, prediction FROM {SQL_SCORED}),
k AS (SELECT dataset, label AS c FROM x UNION SELECT dataset, prediction FROM x),
s AS (SELECT k.dataset, c, count(*) FILTER (label = c)::DOUBLE AS a, count(*) FILTER (prediction = c)::DOUBLE AS q,
             count(*) FILTER (label = c AND prediction = c)::DOUBLE AS h FROM k JOIN x ON k.dataset = x.dataset GROUP BY 1, 2),
m AS (SELECT dataset, a, h, coalesce(h / nullif(q, 0), 0) AS p, coalesce(h / nullif(a, 0), 0) AS r FROM s),
o AS (SELECT dataset, sum(h) / sum(a) AS accuracy, sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * a) / sum(a) AS f1,
             sum(p * a) / sum(a) AS precision, sum(r * a) / sum(a) AS recall FROM m GROUP BY 1)
SELECT dataset, metric, round(value, 6) AS value FROM o
UNPIVOT (value FOR metric IN (accuracy, f1, precision, recall))""")
def _(spark, sf):
    return rounded(cm.multiclass_matrix(scored(spark, sf), ["dataset"]), 6, "value")


@query("win1_row_number", f"""SELECT {SQL_KEY}, row_number() OVER (ORDER BY {_ORDER}) AS rn FROM {SQL_SCORED}""")
def _(spark, sf):
    slim = scored(spark, sf).select(*LINE_KEY, "score")
    return with_position(slim, [F.col("score").desc()] + [F.col(k) for k in LINE_KEY]).select(*LINE_KEY, "rn")


@query("win2_ntile", f"""SELECT {SQL_KEY}, (ntile(10) OVER (ORDER BY {_ORDER}))::INTEGER AS decile FROM {SQL_SCORED}""")
def _(spark, sf):
    slim = scored(spark, sf).select(*LINE_KEY, "score")
    return with_ntile(slim, [], [F.col("score").desc()] + [F.col(k) for k in LINE_KEY]).select(*LINE_KEY, "decile")


@query("win3_running_sums", f"""SELECT decile, target, cum_target, non_target, cum_non_target FROM ({sql_decile(SQL_SCORED)})""")
def _(spark, sf):
    return cm.decile_table(scored(spark, sf), LINE_KEY).select(
        "decile", "target", "cum_target", "non_target", "cum_non_target")
