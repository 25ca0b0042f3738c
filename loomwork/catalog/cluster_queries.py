"""Clustering metric and cluster profile queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomwork.catalog.inputs import rounded, table
from loomwork.catalog.profile_queries import sql_bucket
from loomwork.catalog.registry import query
from loomwork.operators import cluster_profile as cp
from loomwork.operators import clustering_metrics as cu
from loomwork.operators.split import split_frames


def vectors(spark, sf):
    """embeddings as a clustered frame: the label is the cluster."""
    return table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("prediction"))


_ROWS = "(SELECT vec_id, label AS cluster, embedding::DOUBLE[64] AS e FROM embeddings)"
_LONG = f"(SELECT vec_id, cluster, unnest(e::DOUBLE[]) AS v, generate_subscripts(e::DOUBLE[], 1) AS i FROM {_ROWS})"
_CENTRE = f"(SELECT cluster, i, avg(v) AS c, count(*) AS n, var_pop(v) * count(*) AS w FROM {_LONG} GROUP BY 1, 2)"
_SUMMARY = f"(SELECT cluster, max(n) AS n, sum(w) AS w FROM {_CENTRE} GROUP BY 1)"
_DENSITY = f"""(SELECT cluster, avg(d) AS density FROM (SELECT l.vec_id, l.cluster, sqrt(sum((v - c) ** 2)) AS d
 FROM {_LONG} l JOIN {_CENTRE} c ON l.cluster = c.cluster AND l.i = c.i GROUP BY 1, 2) GROUP BY 1)"""
_PAIRS = f"""(SELECT a.cluster AS a, b.cluster AS b, sqrt(sum((a.c - b.c) ** 2)) AS d
 FROM {_CENTRE} a JOIN {_CENTRE} b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY 1, 2)"""


def sql_silhouette(source: str) -> str:
    """Per-row silhouettes straight from the definition: mean squared distance over all pairs of rows."""
    return f"""(
WITH s AS (SELECT * FROM {source}), z AS (SELECT cluster, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.vec_id, a.cluster AS mine, b.cluster AS other, sum(array_distance(a.e, b.e) ** 2) AS t
      FROM s a, s b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, mine, max(n) FILTER (mine = other) AS size, max(CASE WHEN mine = other THEN t / nullif(n - 1, 0) END) AS a,
      min(CASE WHEN mine <> other THEN t / n END) AS b FROM p JOIN z ON other = cluster GROUP BY 1, 2)
SELECT vec_id, mine AS cluster, CASE WHEN size = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM m)"""


@query("cum1_number_of_clusters", "SELECT count(DISTINCT label) AS num_clusters FROM embeddings")
def _(spark, sf):
    return cu.spread_indices(cu.cluster_summary(vectors(spark, sf))).select("num_clusters")


@query("cum2_silhouette", f"SELECT round(avg(s), 6) AS silhouette FROM {sql_silhouette(_ROWS)}")
def _(spark, sf):
    return rounded(cu.silhouette(vectors(spark, sf)), 6, "silhouette")


@query("cum3_inertia", f"SELECT round(sum(w), 6) AS inertia FROM {_SUMMARY}")
def _(spark, sf):
    return rounded(cu.spread_indices(cu.cluster_summary(vectors(spark, sf))).select("inertia"), 6, "inertia")


@query("cum4_calinski_harabasz", f"""
WITH g AS (SELECT i, avg(v) AS m FROM {_LONG} GROUP BY 1), b AS (SELECT sum(n * (c - m) ** 2) AS between FROM {_CENTRE} JOIN g USING (i)),
t AS (SELECT count(*) AS k, sum(n) AS rows, sum(w) AS w FROM {_SUMMARY})
SELECT round((between / (k - 1)) / (w / (rows - k)), 6) AS calinski_harabasz FROM b, t""")
def _(spark, sf):
    return rounded(cu.spread_indices(cu.cluster_summary(vectors(spark, sf))).select("calinski_harabasz"), 6, "calinski_harabasz")


_DB = f"""SELECT avg(r) AS davies_bouldin FROM (SELECT a, max((x.density + y.density) / d) AS r FROM {_PAIRS} p
 JOIN {_DENSITY} x ON x.cluster = a JOIN {_DENSITY} y ON y.cluster = b GROUP BY 1)"""


@query("cum5_davies_bouldin", f"SELECT round(davies_bouldin, 6) AS davies_bouldin FROM ({_DB})")
def _(spark, sf):
    v = vectors(spark, sf)
    s = cu.cluster_summary(v)
    density = cu.cluster_density(cu.with_centre_distances(v, s))
    return rounded(cu.davies_bouldin(cu.centre_distances(s, density)), 6, "davies_bouldin")


@query("cum6_cluster_sizes", """SELECT min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size,
 round(stddev_pop(n) / avg(n), 6) AS balance FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)""")
def _(spark, sf):
    return rounded(cu.size_balance(cu.cluster_sizes(vectors(spark, sf))), 6, "mean_size", "std_size", "balance")


@query("cum7_cluster_centres", f"SELECT cluster, (i - 1)::INTEGER AS feature, round(c, 6) AS value FROM {_CENTRE}")
def _(spark, sf):
    return rounded(cu.cluster_centres(cu.cluster_summary(vectors(spark, sf))), 6, "value")


@query("joi3_centre_distances", f"""SELECT a AS cluster, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest, round(sum(d), 6) AS total
 FROM {_PAIRS} GROUP BY 1""")
def _(spark, sf):
    out = cu.centre_distances(cu.cluster_summary(vectors(spark, sf))).drop("ratio")
    return rounded(out, 6, "nearest", "farthest", "total")


@query("cum8_inter_cluster_distance", f"SELECT round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance, round(avg(d), 6) AS mean_distance FROM {_PAIRS}")
def _(spark, sf):
    out = cu.inter_cluster_distance(cu.centre_distances(cu.cluster_summary(vectors(spark, sf))))
    return rounded(out, 6, "min_distance", "max_distance", "mean_distance")


@query("cum9_cluster_density", f"SELECT cluster, round(density, 6) AS density FROM {_DENSITY}")
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(cu.cluster_density(cu.with_centre_distances(v, cu.cluster_summary(v))), 6, "density")


@query("cum10_row_silhouettes", f"SELECT vec_id, cluster, round(s, 6) AS silhouette FROM {sql_silhouette(_ROWS)}")
def _(spark, sf):
    return rounded(cu.ranked_silhouettes(vectors(spark, sf), ["vec_id"]).select("vec_id", "cluster", "silhouette"), 6, "silhouette")


@query("cum10_silhouette_positions", f"""SELECT vec_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY s, vec_id) AS position,
 count(*) OVER (PARTITION BY cluster) AS cluster_rows FROM {sql_silhouette(_ROWS)}""")
def _(spark, sf):
    return cu.ranked_silhouettes(vectors(spark, sf), ["vec_id"]).select("vec_id", "cluster", "position", "cluster_rows")


@query("cum11_projection")
def _(spark, sf):
    return rounded(cu.project_2d(vectors(spark, sf), ["vec_id"]), 6, "x", "y")


@query("cum11_projected_centres")
def _(spark, sf):
    return rounded(cu.projected_centres(cu.project_2d(vectors(spark, sf), ["vec_id"])), 6, "x", "y")


_NOISY = "(SELECT vec_id, label AS cluster, embedding::DOUBLE[64] AS e FROM embeddings WHERE label <> 0)"


@query("cum12_noise_aware_silhouette", f"SELECT round(avg(s), 6) AS silhouette FROM {sql_silhouette(_NOISY)}")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("prediction", F.when(F.col("prediction") == 0, -1).otherwise(F.col("prediction")))
    return rounded(cu.noise_aware_silhouette(v), 6, "silhouette")


_B = sql_bucket("vec_id::VARCHAR")


def _part(name: str, cond: str) -> str:
    src = f"(SELECT vec_id, label AS cluster, embedding::DOUBLE[64] AS e FROM embeddings WHERE {cond})"
    return f"SELECT '{name}' AS dataset, avg(s) AS silhouette, count(*) AS rows, count(DISTINCT cluster) AS num_clusters FROM {sql_silhouette(src)}"


@query("cum13_dataset_comparison", f"""
WITH t AS ({_part('train', _B + ' < 0.6')} UNION ALL {_part('valid', _B + ' >= 0.6')})
SELECT dataset, round(silhouette, 6) AS silhouette, rows, num_clusters, silhouette = max(silhouette) OVER () AS best,
 round(stddev_pop(silhouette) OVER (), 6) AS silhouette_std, (sum(rows) OVER ())::BIGINT AS total_rows FROM t""")
def _(spark, sf):
    frames = split_frames(vectors(spark, sf), ["vec_id"], {"train": 0.6, "valid": 0.4})
    return rounded(cu.compare_datasets(frames), 6, "silhouette", "silhouette_std")


@query("cum14_scoring_summary", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return cu.cluster_sizes(vectors(spark, sf))


@query("joi2_attach_labels", "SELECT p_partkey, p_retailprice, p_size % 4 AS cluster FROM part")
def _(spark, sf):
    t = table(spark, sf, "part")
    labels = t.select("p_partkey", (F.col("p_size") % 4).alias("prediction"))
    return cu.attach_labels(t.select("p_partkey", "p_retailprice"), labels, ["p_partkey"])


_LINES = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, (l_linenumber % 4)::INTEGER AS cluster FROM lineitem)"
_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_CAT = ["l_returnflag", "l_linestatus"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("cluster", (F.col("l_linenumber") % 4).cast("int"))


def _sql_numeric() -> str:
    return " UNION ALL ".join(f"""
SELECT '{v}' AS variable, cluster, avg({v}) AS mean, stddev_samp({v}) AS std, quantile_cont({v}, 0.5) AS median, min({v}) AS min,
 max({v}) AS max, count(*) AS "count", (avg({v}) - (SELECT avg({v}) FROM {_LINES})) / (SELECT avg({v}) FROM {_LINES}) * 100 AS pct_diff
FROM {_LINES} GROUP BY cluster""" for v in _NUM)


@query("prf1_numeric_profile", f"""SELECT variable, cluster, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median, min, max,
 "count", round(pct_diff, 4) AS pct_diff FROM ({_sql_numeric()})""")
def _(spark, sf):
    return rounded(cp.numeric_profile(_lines(spark, sf), _NUM), 4, "mean", "std", "median", "pct_diff")


_SQL_CATS = " UNION ALL ".join(f"SELECT '{v}' AS variable, cluster, {v} AS category, count(*) AS n FROM {src} GROUP BY 2, 3"
                               for v, src in [("o_orderpriority", "c"), ("o_orderstatus", "c")])
_ORD = "c AS (SELECT o_orderpriority, o_orderstatus, (o_custkey % 3)::INTEGER AS cluster FROM orders)"
_SQL_CATPROFILE = f"""
WITH {_ORD}, k AS ({_SQL_CATS}),
t AS (SELECT variable, category, row_number() OVER (PARTITION BY variable ORDER BY sum(n) DESC, category) AS r FROM k GROUP BY 1, 2),
top AS (SELECT variable, category FROM t WHERE r <= 3), z AS (SELECT variable, cluster, sum(n) AS size FROM k GROUP BY 1, 2),
g AS (SELECT variable, cluster, size, category, true AS is_top_3 FROM z JOIN top USING (variable)
      UNION ALL SELECT variable, cluster, size, 'Other', false FROM z),
m AS (SELECT k.variable, k.cluster, coalesce(top.category, 'Other') AS category, sum(n) AS n FROM k
      LEFT JOIN top ON k.variable = top.variable AND k.category = top.category GROUP BY 1, 2, 3)
SELECT variable, cluster, category, coalesce(n, 0)::BIGINT AS "count", coalesce(n, 0) / size::DOUBLE * 100 AS percentage, is_top_3
FROM g LEFT JOIN m USING (variable, cluster, category)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("cluster", (F.col("o_custkey") % 3).cast("int"))


_OCAT = ["o_orderpriority", "o_orderstatus"]


@query("prf2_categorical_profile", f'SELECT variable, cluster, category, "count", round(percentage, 6) AS percentage, is_top_3 FROM ({_SQL_CATPROFILE})')
def _(spark, sf):
    return rounded(cp.categorical_profile(_orders(spark, sf), _OCAT), 6, "percentage")


@query("prf3_dominant_category", f"""
WITH {_ORD}, k AS ({_SQL_CATS}),
r AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY variable, cluster) * 100 AS p,
      row_number() OVER (PARTITION BY variable, cluster ORDER BY n DESC, category) AS i FROM k)
SELECT variable, cluster, category, round(p, 6) AS percentage, CASE WHEN p > 60 THEN 'dominated' ELSE 'most common' END AS kind FROM r WHERE i = 1""")
def _(spark, sf):
    return rounded(cp.dominant_category(_orders(spark, sf), _OCAT), 6, "percentage")


@query("win4_top_categories", f"""
WITH {_ORD}, k AS ({_SQL_CATS})
SELECT * FROM (SELECT variable, category, sum(n)::BIGINT AS n, (row_number() OVER (PARTITION BY variable ORDER BY sum(n) DESC, category))::INTEGER AS rank
 FROM k GROUP BY 1, 2) WHERE rank <= 3""")
def _(spark, sf):
    return cp.top_categories(cp._category_counts(_orders(spark, sf), _OCAT, "cluster"))


@query("prf4_distinctive_variables", f"""SELECT variable, round(stddev_pop(mean) / avg(mean), 6) AS score FROM ({_sql_numeric()}) GROUP BY 1""")
def _(spark, sf):
    return rounded(cp.distinctive_variables(_lines(spark, sf), _NUM), 6, "score")


_EV = "(SELECT value, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS cluster, user_id FROM events)"


@query("prf5_insights", f"""
WITH e AS (SELECT * FROM {_EV}), n AS (SELECT cluster, count(*) AS n FROM e GROUP BY 1),
v AS (SELECT 'value' AS variable, cluster, (avg(value) - (SELECT avg(value) FROM e)) / (SELECT avg(value) FROM e) * 100 AS d FROM e GROUP BY 2
      UNION ALL SELECT 'user_id', cluster, (avg(user_id) - (SELECT avg(user_id) FROM e)) / (SELECT avg(user_id) FROM e) * 100 FROM e GROUP BY 2),
k AS (SELECT cluster, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY cluster) * 100 AS p,
      row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, event_type) AS i FROM e GROUP BY 1, 2)
SELECT cluster, 'size' AS kind, printf('Size: %d samples (%.1f%% of data)', n, n::DOUBLE / (SELECT count(*) FROM e) * 100) AS insight FROM n
UNION ALL SELECT cluster, 'numeric', printf('%s: %.0f%% %s than average', variable, abs(d), CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END) FROM v WHERE abs(d) > 20
UNION ALL SELECT cluster, 'categorical', printf('event_type: Mostly %s (%.0f%%)', event_type, p) FROM k WHERE i = 1 AND p > 70""")
def _(spark, sf):
    t = table(spark, sf, "events").withColumn("cluster", F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0))
    return cp.cluster_insights(t, ["value", "user_id"], ["event_type"])


@query("prf6_category_pivot", f"""
SELECT variable, category, round(coalesce(sum(percentage) FILTER (cluster = 0), 0), 6) AS cluster_0,
 round(coalesce(sum(percentage) FILTER (cluster = 1), 0), 6) AS cluster_1, round(coalesce(sum(percentage) FILTER (cluster = 2), 0), 6) AS cluster_2
FROM ({_SQL_CATPROFILE}) GROUP BY 1, 2""")
def _(spark, sf):
    out = cp.category_pivot(cp.categorical_profile(_orders(spark, sf), _OCAT), [0, 1, 2])
    return rounded(out, 6, "cluster_0", "cluster_1", "cluster_2")


@query("cum_all_indices", f"""
WITH g AS (SELECT i, avg(v) AS m FROM {_LONG} GROUP BY 1), b AS (SELECT sum(n * (c - m) ** 2) AS between FROM {_CENTRE} JOIN g USING (i)),
t AS (SELECT count(*) AS k, sum(n) AS rows, sum(w) AS w, min(n) AS lo, max(n) AS hi, avg(n) AS mean, stddev_pop(n) AS sd FROM {_SUMMARY})
SELECT k AS num_clusters, rows::BIGINT AS rows, round(w, 6) AS inertia, round((between / (k - 1)) / (w / (rows - k)), 6) AS calinski_harabasz,
 round((SELECT davies_bouldin FROM ({_DB})), 6) AS davies_bouldin, round((SELECT min(d) FROM {_PAIRS}), 6) AS min_distance,
 round((SELECT max(d) FROM {_PAIRS}), 6) AS max_distance, round((SELECT avg(d) FROM {_PAIRS}), 6) AS mean_distance,
 lo AS min_size, hi AS max_size, mean AS mean_size, round(sd, 6) AS std_size, round(sd / mean, 6) AS balance,
 round((SELECT avg(s) FROM {sql_silhouette(_ROWS)}), 6) AS silhouette FROM b, t""")
def _(spark, sf):
    out = cu.all_indices(vectors(spark, sf))
    return rounded(out, 6, "inertia", "calinski_harabasz", "davies_bouldin", "min_distance", "max_distance", "mean_distance",
                   "std_size", "balance", "silhouette")
