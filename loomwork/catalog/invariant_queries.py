"""What fitted and sampled results must obey whatever the fit finds; the SQL states it from the tables alone."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.catalog.cluster_queries import vectors
from loomwork.catalog.inputs import table
from loomwork.catalog.model_queries import _binary, _classified, _folder, _part_vectors, _parts, _regression, BIN_KEY
from loomwork.catalog.prepare_queries import NUMERIC, _labelled
from loomwork.catalog.profile_queries import _RARE, rare_class
from loomwork.catalog.registry import query
from loomwork.functions.columns import hash_code, positive_probability
from loomwork.operators import clustering_metrics as cu
from loomwork.operators import features as fs
from loomwork.operators import profile as pf
from loomwork.operators import tune as tn
from loomwork.operators.dbscan import NOISE, dbscan_search
from loomwork.operators.models import estimator
from loomwork.operators.smote import smote
from loomwork.plans.classification import ClassificationRun
from loomwork.plans.clustering import ClusteringRun
from loomwork.plans.regression import RegressionRun
from loomwork.session import with_row
from loomwork.sources import readers


def _n():
    return F.count(F.lit(1))


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("fun2_hash_codes_hold", "SELECT count(DISTINCT c_name) AS names, count(*) AS n, true AS within, true AS one_code, -999::BIGINT AS blank FROM customer")
def _(spark, sf):
    t = table(spark, sf, "customer").select("c_name", hash_code(F.col("c_name")).cast("bigint").alias("code"), hash_code(F.lit("")).cast("bigint").alias("blank"))
    per = t.groupBy("c_name").agg(_n().alias("n"), F.count_distinct("code").alias("codes"), F.max(F.abs("code")).alias("top"), F.max("blank").alias("blank"))
    return per.agg(_n().alias("names"), F.sum("n").alias("n"), F.bool_and(F.col("top") < 1_000_000).alias("within"),
                   F.bool_and(F.col("codes") == 1).alias("one_code"), F.max("blank").alias("blank"))


@query("prj1_seeded_sample_holds", "SELECT true AS repeats, true AS share_near FROM orders LIMIT 1")
def _(spark, sf):
    o = table(spark, sf, "orders")
    a, b = o.sample(False, 0.2, 42), o.sample(False, 0.2, 42)
    both = with_row(with_row(a.join(b, "o_orderkey").agg(_n().alias("both")), a.agg(_n().alias("one"))), o.agg(_n().alias("all")))
    return both.select((F.col("both") == F.col("one")).alias("repeats"), (F.abs(F.col("one") / F.col("all") - 0.2) < 0.05).alias("share_near"))


@query("src7_read_spec_sampled_holds", "SELECT true AS inside, true AS some FROM orders LIMIT 1")
def _(spark, sf):
    spec = readers.ReadSpec(select=["o_orderkey", "o_totalprice"], where="o_totalprice > 1000", sample_percent=50.0)
    part = spec.apply(table(spark, sf, "orders"))
    strange = part.join(table(spark, sf, "orders").where("o_totalprice > 1000").select("o_orderkey"), "o_orderkey", "left_anti").agg(_n().alias("strange"))
    return with_row(part.agg(_n().alias("n")), strange).select((F.col("strange") == 0).alias("inside"), (F.col("n") > 0).alias("some"))


@query("agg2_approx_distinct_counts_near", "SELECT 'c_name' AS \"column\", true AS near FROM customer UNION SELECT 'c_mktsegment', true FROM customer")
def _(spark, sf):
    t, cols = table(spark, sf, "customer"), ["c_name", "c_mktsegment"]
    exact = pf.distinct_counts(t, cols).withColumnRenamed("distinct", "exact")
    close = F.abs(F.col("distinct") - F.col("exact")) <= 0.15 * F.col("exact")
    return pf.distinct_counts(t, cols, approximate=True).join(exact, "column").select("column", close.alias("near"))


_FEATURE_SUM = "SELECT '{}' AS kind, {} AS features, true AS sums_to_one, count(*) AS n FROM lineitem"


@query("fsl_importances_hold", " UNION ALL ".join(_FEATURE_SUM.format(k, n) for k, n in (("fsl1", 5), ("fsl2", 5), ("fsl6", 4))))
def _(spark, sf):
    t = _labelled(spark, sf)
    kinds = {"fsl1": fs.forest_importances(t, NUMERIC, "label"), "fsl2": fs.forest_importances(t, NUMERIC, "label", adaptive=True),
             "fsl6": fs.forest_importances(t, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", "regression")}
    whole = fs.fit_sample(t, None).agg(_n().alias("n"))
    return with_row(_stack([i.agg(_n().cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one")).select(
        F.lit(k).alias("kind"), "features", "sums_to_one") for k, i in kinds.items()]), whole)


@query("fsl3_sequential_selection_holds", "SELECT 2::BIGINT AS kept, true AS known FROM lineitem LIMIT 1")
def _(spark, sf):
    names = fs.sequential_selection(_labelled(spark, sf), NUMERIC, "label", 2, chunk=3, keep=2)
    return spark.createDataFrame([(len(set(names)), set(names) <= set(NUMERIC))], "kept long, known boolean")


_CLASSIFIERS = {"mdl1": "logistic", "mdl2": "random_forest", "mdl3": "gradient_boosting", "mdl4": "decision_tree", "mdl5": "neural_network"}


@query("mdl1_to_5_classifiers_hold", " UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) AS n, true AS in_range, true AS known_class, {'true' if m == 'decision_tree' else 'NULL'}::BOOLEAN AS not_below_majority FROM lineitem"
    for m in _CLASSIFIERS.values()))
def _(spark, sf):
    rows, width = _binary(spark, sf)
    train = rows.where("dataset = 'train'")
    parts = []
    for name in _CLASSIFIERS.values():
        out = estimator("classification", name, None, features=width).fit(train).transform(rows)
        p, hit = positive_probability(F.col("probability")), (F.col("label") == F.col("prediction")).cast("int")
        on_train = F.col("dataset") == "train"
        got = out.agg(_n().alias("n"), F.bool_and((p >= 0) & (p <= 1)).alias("in_range"), F.bool_and(F.col("prediction").isin(0.0, 1.0)).alias("known_class"),
                      F.avg(F.when(on_train, hit)).alias("_acc"), F.avg(F.when(on_train, F.col("label"))).alias("_ones"))
        better = F.when(F.lit(name == "decision_tree"), F.col("_acc") >= F.greatest("_ones", 1 - F.col("_ones")) - 1e-9)
        parts.append(got.select(F.lit(name).alias("model"), "n", "in_range", "known_class", better.alias("not_below_majority")))
    return _stack(parts)


_REGRESSORS = {"linear_regression": True, "decision_tree": True, "random_forest": False, "gradient_boosting": False, "factorization_machine": False}


@query("mdl6_to_10_regressors_hold", " UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) AS n, true AS finite, {'true' if exact else 'NULL'}::BOOLEAN AS explains, {'true' if exact else 'NULL'}::BOOLEAN AS unbiased FROM lineitem"
    for m, exact in _REGRESSORS.items()))
def _(spark, sf):
    rows = _regression(spark, sf)
    train = rows.where("dataset = 'train'")
    parts = []
    for name, exact in _REGRESSORS.items():
        gap = F.col("label") - F.col("prediction")
        on_train = F.col("dataset") == "train"
        got = estimator("regression", name, {"regParam": 0.0} if name == "linear_regression" else None).fit(train).transform(rows).agg(
            _n().alias("n"), F.bool_and(~F.isnan("prediction") & F.col("prediction").isNotNull()).alias("finite"),
            F.avg(F.when(on_train, gap)).alias("_bias"), F.avg(F.when(on_train, gap * gap)).alias("_mse"), F.var_pop(F.when(on_train, F.col("label"))).alias("_var"))
        parts.append(got.select(F.lit(name).alias("model"), "n", "finite", F.when(F.lit(exact), F.col("_mse") <= F.col("_var") * (1 + 1e-9)).alias("explains"),
                                F.when(F.lit(exact), F.abs("_bias") < 1e-3 * F.sqrt("_var")).alias("unbiased")))
    return _stack(parts)


@query("mdl6_two_feature_plane", """
WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_tax, l_tax) AS zz, covar_pop(l_quantity, l_tax) AS xz,
 covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_tax, l_extendedprice) AS zy FROM lineitem)
SELECT round((xy * zz - zy * xz) / (xx * zz - xz * xz), 2) AS quantity, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 0) AS tax FROM m""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.col("l_extendedprice").alias("label"))
    m = estimator("regression", "linear_regression", {"regParam": 0.0}).fit(VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(t))
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.coefficients[1]))], "quantity double, tax double").select(
        F.round("quantity", 2).alias("quantity"), F.round("tax", 0).alias("tax"))


@query("mdl11_to_13_clusterings_hold", """SELECT 'kmeans' AS model, count(*) AS n, true AS numbered, true AS nearest, true AS within FROM part
 UNION ALL SELECT 'bisecting_kmeans', count(*), true, NULL, true FROM part UNION ALL SELECT 'gaussian_mixture', count(*), true, NULL, NULL FROM part""")
def _(spark, sf):
    rows = _parts(spark, sf)
    x = vector_to_array("features")
    total = rows.agg(*[F.var_pop(x[i]).alias(f"v{i}") for i in range(2)]).select((F.col("v0") + F.col("v1")).alias("spread"))
    parts = []
    for name in ("kmeans", "bisecting_kmeans", "gaussian_mixture"):
        model = estimator("clustering", name, {"k": 4}).fit(rows)
        out = model.transform(rows)
        numbered = (F.col("prediction") >= 0) & (F.col("prediction") < 4)
        nearest, inside = F.lit(None).cast("boolean"), F.lit(None).cast("boolean")
        if name == "gaussian_mixture":
            numbered = numbered & (F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6)
        else:
            far = [(x[0] - float(c[0])) ** 2 + (x[1] - float(c[1])) ** 2 for c in model.clusterCenters()]
            own = F.array(*far)[F.col("prediction")]
            inside = F.avg(own) <= F.max("spread") * (1 + 1e-9)
            nearest = F.bool_and(own <= F.least(*far) + 1e-9) if name == "kmeans" else nearest
        parts.append(with_row(out, total).agg(_n().alias("n"), F.bool_and(numbered).alias("numbered"), nearest.alias("nearest"), inside.alias("within")).select(
            F.lit(name).alias("model"), "n", "numbered", "nearest", "within"))
    return _stack(parts)


@query("mdl15_density_grid_holds", "SELECT 2::BIGINT AS trials, count(*) AS n, true AS best_is_valid FROM part")
def _(spark, sf):
    best, trials = dbscan_search(_part_vectors(spark, sf), ["p_partkey"], eps_values=[0.1, 0.3], min_points_values=[5])
    clusters = best.agg(_n().alias("n"), F.count_distinct(F.when(F.col("prediction") != NOISE, F.col("prediction"))).alias("k"))
    return with_row(trials.agg(_n().alias("trials")), clusters).select("trials", "n", (F.col("k") >= 2).alias("best_is_valid"))


@query("bal2_smote_keys_unique", f"""
WITH c AS (SELECT rare, count(*) AS n FROM {_RARE} GROUP BY 1),
w AS (SELECT *, n::DOUBLE / sum(n) OVER () AS s, floor(max(n) OVER () * 0.3::DOUBLE)::BIGINT AS wanted FROM c)
SELECT sum(CASE WHEN s < 0.3 AND n < wanted THEN wanted ELSE n END)::BIGINT AS keys, true AS inside FROM w""")
def _(spark, sf):
    rows = rare_class(spark, sf)
    low = rows.groupBy("rare").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    out = smote(rows, "rare", ["n_chars", "quality", "toxic"], ["doc_id"]).join(low, "rare")
    return out.agg(F.count_distinct("doc_id").alias("keys"), F.bool_and(F.col("n_chars").between(F.col("low"), F.col("high"))).alias("inside"))


@query("tun_searches_hold", """SELECT * FROM (VALUES ('tun1', 4::BIGINT, 1::BIGINT, true), ('tun2', 4, 1, true)) v(kind, trials, best, best_is_top)
 WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(spark, sf):
    rows, width = _binary(spark, sf)
    train, valid = rows.where("dataset = 'train'"), rows.where("dataset = 'valid'")
    found = {"tun1": tn.random_search("classification", "decision_tree", train, valid, n=4, features=width),
             "tun2": tn.grid_search("classification", "logistic", train, valid, space={"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, features=width)}
    return _stack([t.agg(_n().alias("trials"), F.count_if("best").alias("best"), (F.max("score") == F.max(F.when(F.col("best"), F.col("score")))).alias("best_is_top")
                         ).select(F.lit(k).alias("kind"), "trials", "best", "best_is_top") for k, t in found.items()])


@query("tun4_folds_hold", "SELECT 5 AS folds, true AS between FROM lineitem LIMIT 1")
def _(spark, sf):
    rows, width = _binary(spark, sf)
    out = tn.cross_validate("classification", "decision_tree", rows, BIN_KEY, features=width)
    return out.select("folds", ((F.col("mean") > 0) & (F.col("mean") < 1) & (F.col("std") >= 0)).alias("between"))


@query("tun5_inertia_falls", "SELECT 3::BIGINT AS ks, true AS falls, true AS right_number FROM part LIMIT 1")
def _(spark, sf):
    sweep, _models = tn.sweep_k("bisecting_kmeans", _parts(spark, sf), [2, 3, 4])
    by_k = F.sort_array(F.collect_list(F.struct("k", "inertia")))
    falls = (by_k[0]["inertia"] >= by_k[1]["inertia"]) & (by_k[1]["inertia"] >= by_k[2]["inertia"])
    return sweep.agg(_n().alias("ks"), falls.alias("falls"), F.bool_and(F.col("num_clusters") == F.col("k")).alias("right_number"))


@query("tun8_cluster_folds_hold", "SELECT 4::BIGINT AS metrics, true AS ordered FROM part LIMIT 1")
def _(spark, sf):
    out = tn.cross_validate_clusters("kmeans", _parts(spark, sf), ["p_partkey"], {"k": 3}, folds=3)
    return out.agg(_n().alias("metrics"), F.bool_and((F.col("min") <= F.col("mean")) & (F.col("mean") <= F.col("max"))).alias("ordered"))


@query("cum11_projection_holds", "SELECT count(*) AS n, true AS uncorrelated, true AS ordered, true AS bounded FROM embeddings")
def _(spark, sf):
    v = vectors(spark, sf)
    x = v.select(vector_to_array("features").alias("x"))
    spread = x.agg(*[F.var_samp(F.col("x")[i]).alias(f"v{i}") for i in range(64)]).select(sum((F.col(f"v{i}") for i in range(1, 64)), F.col("v0")).alias("spread"))
    p = cu.project_2d(v, ["vec_id"]).agg(_n().alias("n"), F.covar_samp("x", "y").alias("c"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    return with_row(p, spread).select("n", (F.abs("c") < 1e-6 * F.col("vx")).alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("ordered"),
                                                   (F.col("vx") + F.col("vy") <= F.col("spread") * (1 + 1e-9)).alias("bounded"))


@query("pipe1_classification_run_holds", """SELECT CASE WHEN year(o_orderdate) <= 1999 THEN 'split' WHEN year(o_orderdate) = 2000 THEN 'oot1' ELSE 'oot2' END AS part,
 count(*) AS n, 1::BIGINT AS champions FROM orders GROUP BY 1""")
def _(spark, sf):
    run, _frames = _classified(spark, sf, models=["logistic", "decision_tree"])
    part = F.when(F.col("dataset").isin("train", "valid", "test"), "split").otherwise(F.col("dataset"))
    champions = run.ranking.agg(F.count_if(F.col("rank") == 1).alias("champions"))
    return with_row(run.prepared.rows.groupBy(part.alias("part")).agg(_n().alias("n")), champions)


@query("snk1_saved_run_tables", "SELECT count(*) AS predictions, true AS metrics, 1::BIGINT AS champions FROM orders")
def _(spark, sf):
    run, _frames = _classified(spark, sf, models=["decision_tree"])
    path = _folder(spark, "tables")
    run.save(path)
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("predictions", "metrics", "ranking")}
    champions = read["ranking"].agg(F.count_if(F.col("rank") == 1).alias("champions"))
    return with_row(with_row(read["predictions"].agg(_n().alias("predictions")), read["metrics"].agg((_n() > 0).alias("metrics"))), champions)


@query("pipe3_holdout_without_column", "SELECT 'short' AS dataset, false AS usable, count(*) AS judged FROM customer UNION ALL SELECT 'whole', true, count(*) FROM customer")
def _(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    run = ClusteringRun(models=["kmeans"], ks=[2, 3]).fit(t, ["c_custkey"], {"short": t.drop("c_acctbal"), "whole": t})
    judged = run.assignments.where("dataset = 'whole'").agg(_n().alias("judged"))
    return with_row(run.holdout_report.select("dataset", "usable"), judged)


@query("pipe1_boolean_target", "SELECT (l_returnflag = 'R') AS predicted_of, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("target", F.col("l_returnflag") == "R").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    run = ClassificationRun(models=["decision_tree"]).fit(t.select("row", "l_quantity", "l_tax", "l_returnflag", "target"), "target", ["row"])
    return run.predict(t.select("row", "l_quantity", "l_tax", "l_returnflag")).groupBy((F.col("predicted_class") == "true").alias("predicted_of")).agg(_n().alias("n"))


@query("pipe2_text_target_codes", """SELECT DISTINCT o_orderstatus AS status, dense_rank() OVER (ORDER BY n DESC, o_orderstatus)::DOUBLE - 1 AS code
 FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) <= 1999 GROUP BY 1)""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("kept", F.col("o_orderstatus"))
    coder = pf.fit_target(o.where(F.year("o_orderdate") <= 1999), "o_orderstatus")
    both = coder.apply(o.where(F.year("o_orderdate") <= 1999)).unionByName(coder.apply(o.where(F.year("o_orderdate") > 1999)))
    return both.select(F.col("kept").alias("status"), F.col("o_orderstatus").alias("code")).distinct()


@query("pipe2_regression_run_holds", "SELECT count(*) AS n, 1::BIGINT AS champions, 0::BIGINT AS dropped FROM part")
def _(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    run = RegressionRun(models=["linear_regression", "decision_tree"]).fit(t, "p_retailprice", ["p_partkey"])
    champions = run.ranking.agg(F.count_if(F.col("rank") == 1).alias("champions"))
    return with_row(run.prepared.rows.agg(_n().alias("n")), champions).withColumn("dropped", F.lit(run.dropped["train"]).cast("bigint"))


@query("pipe3_clustering_run_holds", "SELECT count(*) AS n, true AS whole FROM customer")
def _(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    run = ClusteringRun(models=["kmeans"], ks=[2, 3, 4]).fit(t, ["c_custkey"])
    sums = run.profile()["numeric"].groupBy("variable").agg(F.sum("count").alias("n"))
    return sums.agg(F.max("n").alias("n"), (F.max("n") == F.min("n")).alias("whole"))


@query("sco1_predict_new_rows_holds", "SELECT count(*) AS n, true AS known FROM orders WHERE year(o_orderdate) = 2000")
def _(spark, sf):
    run, frames = _classified(spark, sf, models=["decision_tree"])
    out = run.predict(frames["oot1"].drop("target"))
    return out.agg(_n().alias("n"), F.bool_and(F.col("predicted_class").isin("final", "open")).alias("known"))
