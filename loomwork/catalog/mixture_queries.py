"""Queries of regularised mixtures and of the agreement of clusterings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomwork.catalog.inputs import rounded, table
from loomwork.catalog.model_queries import _part_vectors, _parts
from loomwork.catalog.registry import query
from loomwork.operators.agreement import MEASURES, agreement, cluster_stability
from loomwork.operators.euclidean_silhouette import euclidean_silhouette
from loomwork.operators.mixture import Mixture, MixtureModel, RegularisedMixture, em_step, table_prior

#: Fixed start of the one-step query: means of size and price inside the prices of every scale, so that no component is empty.
_START = [[10.0, 905.0], [30.0, 910.0], [45.0, 915.0]]
_SHARE = 0.05


@query("mdl13_mixture_step", f"""
WITH t AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM part),
g AS (SELECT count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, {_SHARE} * count(*) / {len(_START)} AS r FROM t),
m(k, ma, mb) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_START))}),
d AS (SELECT k, a, b, exp(-((a - ma) ** 2 / va + (b - mb) ** 2 / vb) / 2) AS e FROM t, m, g),
w AS (SELECT k, a, b, e / sum(e) OVER (PARTITION BY a, b) * count(*) OVER (PARTITION BY k, a, b) AS s FROM d),
c AS (SELECT k, sum(s) AS n, sum(s * a) / sum(s) AS ma, sum(s * b) / sum(s) AS mb FROM w GROUP BY k)
SELECT k::INTEGER AS component, round((c.n + 1) / (g.n + {len(_START)}), 6) AS weight, round(c.ma, 5) AS mean_size, round(c.mb, 4) AS mean_price,
 round((sum(s * (a - ma) ** 2) + r * va) / (c.n + r), 4) AS var_size, round(sum(s * (a - ma) * (b - mb)) / (c.n + r), 3) AS covariance,
 round((sum(s * (b - mb) ** 2) + r * vb) / (c.n + r), 2) AS var_price
FROM w JOIN c USING (k), g GROUP BY k, c.n, g.n, c.ma, c.mb, r, va, vb""")
def _(spark, sf):
    rows = _part_vectors(spark, sf).select(vector_to_array("features").alias("x"))
    prior = table_prior(rows, len(_START), _SHARE)
    start = Mixture(np.full(3, 1 / 3), np.array(_START), np.repeat(np.diag(prior.spread)[None], 3, axis=0))
    out = MixtureModel(em_step(rows, start, prior)[0]).components(spark)
    cov = F.col("covariance")
    out = out.select("component", "weight", F.col("mean")[0].alias("mean_size"), F.col("mean")[1].alias("mean_price"), cov[0][0].alias("var_size"),
                     cov[0][1].alias("covariance"), cov[1][1].alias("var_price"))
    for digits, names in ((6, ["weight"]), (5, ["mean_size"]), (4, ["mean_price", "var_size"]), (3, ["covariance"]), (2, ["var_price"])):
        out = rounded(out, digits, *names)
    return out


@query("mdl13_mixture_fit", "SELECT count(*) AS n, true AS normalised, true AS weights_hold, true AS means_hold, true AS never_falls FROM part")
def _(spark, sf):
    """Shares add up to 1, their means give back weights and means of the model, and no round lowers the penalised likelihood."""
    rows = _parts(spark, sf)
    model = RegularisedMixture(k=4, maxIter=200, tol=1e-5).fit(rows)
    rises = all(b - a > -1e-6 * abs(a) for a, b in zip(model.history, model.history[1:]))
    p = model.transform(rows).select(vector_to_array("probability").alias("p"), vector_to_array("features").alias("x"))
    long = p.select("x", F.posexplode("p").alias("component", "s")).groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("share"), *[(F.sum(F.col("s") * F.col("x")[i]) / F.sum("s")).alias(f"m{i}") for i in (0, 1)])
    both = long.join(F.broadcast(model.components(spark)), "component")
    far = F.greatest(*[F.abs(F.col(f"m{i}") - F.col("mean")[i]) for i in (0, 1)])
    return both.agg(F.max("n").alias("n"), (F.abs(F.sum("share") - 1) < 1e-9).alias("normalised"), (F.max(F.abs(F.col("share") - F.col("weight"))) < 0.01).alias("weights_hold"),
                    (F.max(far) < 0.05).alias("means_hold"), F.lit(rises).alias("never_falls"))


# Pairs of rows are counted one by one; the expected information sums the whole hypergeometric law.
@query("sel7_clustering_agreement", """
WITH t AS (SELECT p_partkey AS id, p_size // 10 AS a, (p_size + p_partkey % 7) // 8 AS b FROM part),
z AS (SELECT count(*)::DOUBLE AS n FROM t), c AS (SELECT a, b, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
x AS (SELECT a, count(*)::DOUBLE AS x FROM t GROUP BY 1), y AS (SELECT b, count(*)::DOUBLE AS y FROM t GROUP BY 1),
p AS (SELECT count(*)::DOUBLE AS pairs, (count(*) FILTER (s.a = u.a AND s.b = u.b))::DOUBLE AS yes, (count(*) FILTER (s.a = u.a))::DOUBLE AS pa,
      (count(*) FILTER (s.b = u.b))::DOUBLE AS pb FROM t s JOIN t u ON s.id < u.id),
m AS (SELECT sum(c / n * ln(n * c / (x * y))) AS mi FROM c JOIN x USING (a) JOIN y USING (b), z),
h AS (SELECT (SELECT -sum(x / n * ln(x / n)) FROM x, z) AS ha, (SELECT -sum(y / n * ln(y / n)) FROM y, z) AS hb),
k AS (SELECT x, y, n, unnest(range(greatest(1, x + y - n)::BIGINT, least(x, y)::BIGINT + 1))::DOUBLE AS v FROM x, y, z),
e AS (SELECT sum(v / n * ln(n * v / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(v + 1)
      - lgamma(x - v + 1) - lgamma(y - v + 1) - lgamma(n - x - y + v + 1))) AS emi FROM k)
SELECT n::BIGINT AS rows, round((pairs + 2 * yes - pa - pb) / pairs, 6) AS rand, round((yes - pa * pb / pairs) / ((pa + pb) / 2 - pa * pb / pairs), 6) AS adjusted_rand,
 round(mi, 6) AS mutual_information, round(2 * mi / (ha + hb), 6) AS normalised_mutual_information,
 round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS adjusted_mutual_information, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness
FROM z, p, m, h, e""")
def _(spark, sf):
    t = table(spark, sf, "part").select(F.expr("p_size div 10").alias("a"), F.expr("(p_size + p_partkey % 7) div 8").alias("b"))
    return rounded(agreement(t, "a", "b"), 6, *MEASURES)


@query("tun8_cluster_stability", "SELECT 'fit' || i AS first, 'fit' || j AS second, count(*) AS rows, true AS within, true AS better_than_chance "
       "FROM part, range(3) r(i), range(3) s(j) WHERE i < j GROUP BY ALL")
def _(spark, sf):
    out = cluster_stability("kmeans", _parts(spark, sf), ["p_partkey"], {"k": 3}, folds=3)
    return out.select("first", "second", "rows", F.greatest("rand", "adjusted_rand", "adjusted_mutual_information").between(-1, 1 + 1e-9).alias("within"),
                      ((F.col("adjusted_rand") > 0.05) & (F.col("adjusted_mutual_information") > 0.05)).alias("better_than_chance"))


_GROUPED = "SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b, (p_partkey % 400) // 100 + 4 * (p_size // 30) AS c FROM part"


@query("cum10_euclidean_silhouettes", f"""
WITH t AS ({_GROUPED}), z AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
d AS (SELECT u.id, u.c, v.c AS o, sum(sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2)) AS s FROM t u, t v GROUP BY 1, 2, 3),
m AS (SELECT id, max(CASE WHEN d.c = o THEN s / (n - 1) END) AS x, min(CASE WHEN d.c <> o THEN s / n END) AS y FROM d JOIN z ON o = z.c GROUP BY id)
SELECT count(*) AS rows, round(avg((y - x) / greatest(x, y)), 2) AS silhouette, true AS within FROM m""")
def _(spark, sf):
    """With ever more cells the bounds close on the mean over all pairs of rows."""
    t = table(spark, sf, "part").select("p_partkey", F.expr("(p_partkey % 400) div 100 + 4 * (p_size div 30)").alias("prediction"),
                                        array_to_vector(F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))).alias("features"))
    out = euclidean_silhouette(t, tolerance=0.002, cells=1024)
    return out.select("rows", F.round("silhouette", 2).alias("silhouette"), (F.col("high") - F.col("low") <= 0.01).alias("within"))
