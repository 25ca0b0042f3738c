"""Model, tuning, balancing, density-clustering, scoring, explanation and whole-run queries."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from loomwork.catalog.inputs import LINE_KEY, SQL_KEY, rounded, table
from loomwork.catalog.profile_queries import _RARE, rare_class, sql_bucket
from loomwork.catalog.registry import query
from loomwork.functions.columns import positive_probability
from loomwork.operators import classification_metrics as cm
from loomwork.operators import choose as ch
from loomwork.operators import encode as en
from loomwork.operators import explain as ex
from loomwork.operators import regression_metrics as rm
from loomwork.operators import tune as tn
from loomwork.operators import vector_index as vi
from loomwork.operators.dbscan import dbscan, dbscan_search
from loomwork.operators.models import estimator
from loomwork.operators.score import score
from loomwork.operators.smote import class_neighbours, smote
from loomwork.operators.split import assign_split
from loomwork.plans.classification import ClassificationRun
from loomwork.plans.clustering import ClusteringRun
from loomwork.plans.regression import RegressionRun
from loomwork.session import evenly, shared_dir, stage, unstage
from loomwork.sources import readers, sinks
from loomwork.streaming.arrivals import score_arrivals

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
SPLIT = {"train": 0.6, "valid": 0.2, "test": 0.2}


def _binary(spark, sf):
    """lineitem, encoded and split: label = returned."""
    t = table(spark, sf, "lineitem").withColumn("label", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    spec = en.FeatureSpec("label", categorical=["l_linestatus"], numeric=NUMERIC)
    # the key hash is dear, so it is taken once; the encoder only counts and sums, so its passes need no shuffled rows
    split = stage(assign_split(t, LINE_KEY, SPLIT).select(*[F.col(k).alias(f"k_{k}") for k in LINE_KEY], "dataset", "label", *spec.raw), "split")
    model = en.fit_encoder(en.prepare_columns(split, spec).where("dataset = 'train'"), spec)
    ready = model.transform(en.prepare_columns(evenly(split, *BIN_KEY), spec))
    out = stage(ready.select(*BIN_KEY, "dataset", "label", "features"), "binary")
    unstage(split)
    return out, len(spec.encoded)


BIN_KEY = [f"k_{k}" for k in LINE_KEY]


def _judge_classifier(spark, sf, name, params=None):
    rows, width = _binary(spark, sf)
    model = estimator("classification", name, params, features=width).fit(rows.where("dataset = 'train'"))
    out = stage(model.transform(rows).select(*BIN_KEY, "dataset", "label", "prediction",
                                             positive_probability(F.col("probability")).alias("score")), "scored")
    return rounded(cm.metric_matrix(out, BIN_KEY, ["dataset"]), 2, "value")


def flagship(spark, sf):
    """Fit a logistic regression on the training part and build the gain table of the test part."""
    rows, width = _binary(spark, sf)
    model = estimator("classification", "logistic", features=width).fit(rows.where("dataset = 'train'"))
    out = model.transform(rows.where("dataset = 'test'"))
    scored = out.select(*BIN_KEY, "label", positive_probability(F.col("probability")).alias("score"))
    return cm.decile_table(scored, BIN_KEY)


@query("clm4_fitted_decile_table")
def _(spark, sf):
    return flagship(spark, sf)


@query("fun4_positive_probability", "SELECT 'within' AS range, count(*) AS n FROM lineitem")
def _(spark, sf):
    rows, width = _binary(spark, sf)
    out = estimator("classification", "logistic", features=width).fit(rows).transform(rows)
    p = positive_probability(F.col("probability"))
    return out.select(F.when((p >= 0) & (p <= 1), "within").otherwise("outside").alias("range")).groupBy("range").agg(F.count(F.lit(1)).alias("n"))


for _name, _id in [("logistic", "mdl1"), ("random_forest", "mdl2"), ("gradient_boosting", "mdl3"), ("decision_tree", "mdl4"),
                   ("neural_network", "mdl5")]:
    query(f"{_id}_{_name}_classifier")(lambda spark, sf, n=_name: _judge_classifier(spark, sf, n))


def _regression(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("label", F.col("l_extendedprice"))
    feats = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    v = VectorAssembler(inputCols=feats, outputCol="features").transform(assign_split(evenly(t, *LINE_KEY), LINE_KEY, SPLIT))
    return stage(v.select(*LINE_KEY, "dataset", "label", "features"), "regression")


def _judge_regressor(spark, sf, name, params=None):
    rows = _regression(spark, sf)
    model = estimator("regression", name, params).fit(rows.where("dataset = 'train'"))
    out = model.transform(rows).select("dataset", F.col("label").alias("actual"), "prediction")
    m = rm.regression_metrics(out, groups=["dataset"]).select("dataset", "rmse", "mae", "r2")
    return rounded(rounded(m, 0, "rmse", "mae"), 1, "r2")


for _name, _id in [("linear_regression", "mdl6"), ("random_forest", "mdl7"), ("gradient_boosting", "mdl8"), ("decision_tree", "mdl9"),
                   ("factorization_machine", "mdl10")]:
    query(f"{_id}_{_name}_regressor")(lambda spark, sf, n=_name: _judge_regressor(spark, sf, n))


@query("mdl6_single_feature_line", """SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(t)
    m = estimator("regression", "linear_regression", {"regParam": 0.0}).fit(rows)
    out = spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")
    return rounded(rounded(out, 3, "slope"), 1, "intercept")


def _parts(spark, sf):
    """part as clustering rows: standardised size and price."""
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    spec = en.FeatureSpec(None, numeric=["size", "price"])
    return stage(en.fit_encoder(t, spec).transform(t).select("p_partkey", "features"), "parts")


for _name, _id in [("kmeans", "mdl11"), ("bisecting_kmeans", "mdl12"), ("gaussian_mixture", "mdl13")]:
    def _cluster(spark, sf, n=_name):
        from loomwork.operators.clustering_metrics import all_indices
        rows = _parts(spark, sf)
        out = estimator("clustering", n, {"k": 4}).fit(rows).transform(rows)
        return all_indices(out).select("num_clusters", "rows", F.round("silhouette", 2).alias("silhouette"))
    query(f"{_id}_{_name}")(_cluster)


EPS, MIN_POINTS = 0.1, 5
_Z = """z AS MATERIALIZED (SELECT p_partkey AS id, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) AS a,
 (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) AS b FROM part),
near AS MATERIALIZED (SELECT u.id AS p, v.id AS q FROM z u JOIN z v ON (u.a - v.a) ** 2 + (u.b - v.b) ** 2 <= 0.1::DOUBLE * 0.1::DOUBLE),
core AS MATERIALIZED (SELECT p AS id FROM near GROUP BY 1 HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT p, q FROM near WHERE p IN (FROM core) AND q IN (FROM core))"""


def _part_vectors(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return VectorAssembler(inputCols=["size", "price"], outputCol="features").transform(t).select("p_partkey", "features")


@query("joi5_neighbourhood_cores", f"WITH {_Z} SELECT id AS p_partkey, id IN (FROM core) AS core FROM z")
def _(spark, sf):
    return dbscan(_part_vectors(spark, sf), ["p_partkey"], EPS, MIN_POINTS).select("p_partkey", "core")


@query("mdl14_density_clusters", f"""
WITH RECURSIVE {_Z},
r AS (SELECT id AS root, id AS v FROM core UNION SELECT r.root, q FROM r JOIN link ON r.v = p WHERE q > root),
c AS (SELECT v, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS no FROM (SELECT DISTINCT root FROM c)),
l AS (SELECT v AS id, no FROM c JOIN n USING (root)),
b AS (SELECT p AS id, min(no) AS no FROM near JOIN l ON q = l.id WHERE p NOT IN (FROM core) GROUP BY 1)
SELECT z.id AS p_partkey, coalesce(l.no, b.no, -1)::INTEGER AS prediction FROM z LEFT JOIN l ON z.id = l.id LEFT JOIN b ON z.id = b.id""")
def _(spark, sf):
    return dbscan(_part_vectors(spark, sf), ["p_partkey"], EPS, MIN_POINTS).select("p_partkey", "prediction")


@query("mdl15_density_grid")
def _(spark, sf):
    _best, trials = dbscan_search(_part_vectors(spark, sf), ["p_partkey"], eps_values=[0.1, 0.3], min_points_values=[5])
    return rounded(rounded(trials, 3, "silhouette"), 3, "noise_percentage")


VECTOR_RECALL = 0.95


def _vector_index(spark, sf):
    """Index over all embeddings, its queries (every row whose id 100 divides) and the probes for the wanted recall."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    index = vi.build_index(vectors, len(vectors.first()["x"]))
    return index, vectors.where("id % 100 = 0"), vi.calibrated_probes(index, 10, VECTOR_RECALL)


@query("joi4_index_exact_neighbours", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)
SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_distance(a.x, b.x), 6) AS distance,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id)::INTEGER AS rank
FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10""")
def _(spark, sf):
    index, asked, probes = _vector_index(spark, sf)
    return vi.nearest(index, asked, 10, probes, exact=True).select("id", "neighbour", F.round(F.sqrt("d2"), 6).alias("distance"), "rank")


@query("joi4_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, sf):
    index, asked, probes = _vector_index(spark, sf)
    found = vi.recall(vi.nearest(index, asked, 10, probes), vi.nearest(index, asked, 10, probes, exact=True))
    return found.select("queries", (F.col("recall") >= VECTOR_RECALL).alias("reached"))


@query("joi4_nearest_neighbours", """
SELECT a.p_partkey, b.p_partkey AS neighbour, row_number() OVER (PARTITION BY a.p_partkey ORDER BY (a.p_size - b.p_size)::DOUBLE ** 2
 + (a.p_retailprice - b.p_retailprice) ** 2, b.p_partkey)::INTEGER AS rank
FROM part a JOIN part b ON a.p_partkey <> b.p_partkey QUALIFY rank <= 5""")
def _(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    rows, near = class_neighbours(t, ["p_size", "p_retailprice"], ["p_partkey"])
    names = rows.select("id", "p_partkey")
    return near.join(names, "id").join(names.select(F.col("id").alias("neighbour"), F.col("p_partkey").alias("other")), "neighbour").select(
        "p_partkey", F.col("other").alias("neighbour"), F.col("rank").cast("int").alias("rank"))


@query("bal2_smote_counts", f"""
WITH c AS (SELECT rare, count(*) AS n FROM {_RARE} GROUP BY 1),
w AS (SELECT *, n::DOUBLE / sum(n) OVER () AS s, floor(max(n) OVER () * 0.3::DOUBLE)::BIGINT AS wanted FROM c)
SELECT rare, CASE WHEN s < 0.3 AND n < wanted THEN wanted ELSE n END AS n FROM w""")
def _(spark, sf):
    out = smote(rare_class(spark, sf), "rare", ["n_chars", "quality", "toxic"], ["doc_id"])
    return out.groupBy("rare").agg(F.count(F.lit(1)).alias("n"))


@query("bal2_smote_rows")
def _(spark, sf):
    return smote(rare_class(spark, sf), "rare", ["n_chars", "quality", "toxic"], ["doc_id"])


@query("tun1_random_search_classification")
def _(spark, sf):
    rows, width = _binary(spark, sf)
    out = tn.random_search("classification", "decision_tree", rows.where("dataset = 'train'"), rows.where("dataset = 'valid'"), n=4, features=width)
    return rounded(out, 2, "score")


@query("tun1_random_search_regression")
def _(spark, sf):
    rows = _regression(spark, sf)
    return tn.random_search("regression", "decision_tree", rows.where("dataset = 'train'"), rows.where("dataset = 'valid'"), n=3).select("trial", "params")


@query("tun1_random_search_clustering")
def _(spark, sf):
    return rounded(tn.random_search("clustering", "kmeans", _parts(spark, sf), n=3), 1, "score")


@query("tun2_grid_search")
def _(spark, sf):
    rows, width = _binary(spark, sf)
    space = {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}
    out = tn.grid_search("classification", "logistic", rows.where("dataset = 'train'"), rows.where("dataset = 'valid'"), space=space, features=width)
    return rounded(out, 2, "score")


@query("tun4_cross_validation")
def _(spark, sf):
    rows, width = _binary(spark, sf)
    out = tn.cross_validate("classification", "logistic", rows, BIN_KEY, features=width)
    return rounded(out, 2, "mean", "std")


@query("tun5_k_sweep")
def _(spark, sf):
    table_, _models = tn.sweep_k("kmeans", _parts(spark, sf), [2, 3, 4])
    return rounded(table_, 2, "silhouette").select("k", "num_clusters", "silhouette")


@query("tun8_cluster_cross_validation")
def _(spark, sf):
    out = tn.cross_validate_clusters("kmeans", _parts(spark, sf), ["p_partkey"], {"k": 3}, folds=3)
    return rounded(out, 1, "mean", "std", "min", "max")


def _folder(spark, name):
    return f"{shared_dir(spark)}/models/{name}-{uuid.uuid4().hex}"


@query("snk4_save_and_load", "SELECT true AS same, count(*) AS n, 'logistic' AS champion FROM lineitem")
def _(spark, sf):
    """Predictions before saving and after loading, compared row by row."""
    rows, width = _binary(spark, sf)
    model = PipelineModel(stages=[estimator("classification", "logistic", features=width).fit(rows)])
    path = _folder(spark, "logistic")
    sinks.save_model(model, path, {"champion": "logistic"})
    again, info = sinks.load_model(spark, path)
    a = model.transform(rows).select(*BIN_KEY, F.col("prediction").alias("before"))
    b = again.transform(rows).select(*BIN_KEY, F.col("prediction").alias("after"))
    same = a.join(b, BIN_KEY).groupBy((F.col("before") == F.col("after")).alias("same")).agg(F.count(F.lit(1)).alias("n"))
    return same.withColumn("champion", F.lit(info["champion"]))


def _explained(spark, sf):
    """A decision tree on part, its contributions for every row, and the rows and features."""
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
                                        (F.col("p_partkey") % 7).cast("double").alias("seven"))
    feats = ["size", "price", "seven"]
    rows = VectorAssembler(inputCols=feats, outputCol="features").transform(t.withColumn("label", F.col("price") * 2 + F.col("size")))
    tree = estimator("regression", "decision_tree").fit(rows)
    model = PipelineModel(stages=[VectorAssembler(inputCols=feats, outputCol="features"), tree])
    return model, t, feats, ex.shapley_values(model, t, t, feats, ["p_partkey"], background_rows=8)


@query("exp1_shapley_values")
def _(spark, sf):
    return rounded(_explained(spark, sf)[3], 3, "phi")


@query("exp1_contributions_add_up", "SELECT true AS adds_up, count(*) AS n FROM part")
def _(spark, sf):
    """Per row the contributions sum to its prediction minus the mean prediction of the background."""
    model, t, feats, phi = _explained(spark, sf)
    drawn = ex.background_draws(t, t, feats, ["p_partkey"], 8).select("p_partkey", *[F.col("bg")[i].alias(f) for i, f in enumerate(feats)])
    base = model.transform(drawn).groupBy("p_partkey").agg(F.avg("prediction").alias("base"))
    fitted = model.transform(t).select("p_partkey", "prediction")
    sums = phi.groupBy("p_partkey").agg(F.sum("phi").alias("total")).join(fitted.hint("merge"), "p_partkey").join(base.hint("merge"), "p_partkey")
    close = F.abs(F.col("total") - (F.col("prediction") - F.col("base"))) < 1e-6
    return sums.withColumn("adds_up", close).groupBy("adds_up").agg(F.count(F.lit(1)).alias("n"))


def _orders_by_year(spark, sf):
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate")
    return {"train": o.where(year <= 1999), "oot1": o.where(year == 2000), "oot2": o.where(year > 2000)}


def _classified(spark, sf, **settings):
    frames = _orders_by_year(spark, sf)
    run = ClassificationRun(**{"models": ["logistic", "decision_tree"], **settings})
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate", "target"]
    frames = {n: f.withColumn("target", F.when(F.col("o_orderstatus") == "F", "final").otherwise("open")).select(*cols) for n, f in frames.items()}
    return run.fit(frames.pop("train"), "target", ["o_orderkey"], frames), frames


@query("pipe1_classification_run")
def _(spark, sf):
    run, _ = _classified(spark, sf, models=None)
    return rounded(run.metrics, 1, "value")


@query("pipe1_tuned_classification_run")
def _(spark, sf):
    run, _ = _classified(spark, sf, tune="random", trials=2)
    return run.decisions.select("model", "decision", "reason")


@query("pipe1_multiclass_run")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    run = ClassificationRun(models=["logistic", "random_forest"]).fit(o, "o_orderpriority", ["o_orderkey"])
    return run.ranking.select("rank", "model", "metric", "stability_score", "role")


@query("pipe1_balanced_run", f"""
WITH c AS (SELECT rare, count(*) AS n FROM {_RARE} WHERE {sql_bucket('doc_id::VARCHAR')} < 0.4 GROUP BY 1),
w AS (SELECT *, n::DOUBLE / sum(n) OVER () AS s, floor(max(n) OVER () * 0.3::DOUBLE)::BIGINT AS wanted FROM c)
SELECT rare::DOUBLE AS label, CASE WHEN (SELECT min(s) FROM w) < 0.05 AND s < 0.3 AND n < wanted THEN wanted ELSE n END AS n FROM w""")
def _(spark, sf):
    t = rare_class(spark, sf).select("doc_id", "n_chars", "quality", "rare")
    run = ClassificationRun(models=["logistic"], balance="smote").fit(t, "rare", ["doc_id"])
    return run.prepared.train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("pipe2_regression_run")
def _(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    run = RegressionRun(models=["linear_regression", "decision_tree", "gradient_boosting", "random_forest"]).fit(t, "p_retailprice", ["p_partkey"])
    return rounded(run.metrics.where("metric IN ('rmse', 'mae')"), -1, "value").select("model", "variant", "dataset", "metric", "value")


@query("pipe3_clustering_run")
def _(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    run = ClusteringRun(ks=[2, 3, 4]).fit(t, ["c_custkey"])
    return run.ranking.select("rank", "model", "dataset", "selected")


@query("pipe3_cluster_profiles")
def _(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    run = ClusteringRun(models=["kmeans"], ks=[2, 3, 4]).fit(t, ["c_custkey"])
    return run.profile()["numeric"].select("variable", "cluster", "count")


@query("src10_fit_from_source", """SELECT dataset, 3::BIGINT AS metrics FROM (VALUES ('train'), ('valid'), ('test'), ('oot1'), ('oot2')) v(dataset)
 WHERE (SELECT count(*) FROM orders) > 0""")
def _(spark, sf):
    folder = _folder(spark, "orders")
    for name, df in _orders_by_year(spark, sf).items():
        df.withColumn("target", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).write.parquet(f"{folder}/{name}.parquet")
    spec = readers.ReadSpec(select=["o_orderkey", "o_totalprice", "o_orderpriority", "target"], where="o_totalprice > 0")
    frames = readers.load_bundle(spark, (f"{folder}/train.parquet", spec), {n: f"{folder}/{n}.parquet" for n in ("oot1", "oot2")})
    run = ClassificationRun(models=["logistic"]).fit(frames.pop("train"), "target", ["o_orderkey"], frames)
    return run.metrics.groupBy("dataset").agg(F.count(F.lit(1)).alias("metrics"))


@query("sco1_predict_new_rows")
def _(spark, sf):
    run, frames = _classified(spark, sf, models=["decision_tree"])
    out = run.predict(frames["oot1"].drop("target"))
    return out.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"))


@query("sco2_score_from_disk", "SELECT true AS same, count(*) AS n FROM orders WHERE year(o_orderdate) > 2000")
def _(spark, sf):
    """Every row of the hold-out scored by the run in memory and by the saved copy: all must agree."""
    run, frames = _classified(spark, sf, models=["decision_tree"])
    path = _folder(spark, "run")
    run.save(path)
    new = frames["oot2"].drop("target")
    a = run.predict(new).select("o_orderkey", F.col("predicted_class").alias("live"))
    b = score(path, new, output=f"{path}/scored").select("o_orderkey", "predicted_class")
    return a.join(b, "o_orderkey").groupBy((F.col("live") == F.col("predicted_class")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("sco2_regression_from_disk", "SELECT count(*) AS rows, count(*) AS residuals, count(*) AS errors FROM part")
def _(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", F.col("p_retailprice").alias("actual"))
    run = RegressionRun(models=["linear_regression"]).fit(t, "actual", ["p_partkey"])
    path = _folder(spark, "run")
    run.save(path)
    out = score(path, t)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count("residual").alias("residuals"), F.count_if(F.col("absolute_error") >= 0).alias("errors"))


@query("sco2_arriving_files", """SELECT count(*) FILTER (o_orderkey % 2 = 0) AS first, 0::BIGINT AS again, count(*) FILTER (o_orderkey % 2 = 1) AS later,
 count(*) AS written, true AS once FROM orders""")
def _(spark, sf):
    """Rows scored by a first call over some files, a second over the same, a third after more arrived; each key is written once."""
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"))
    folder = _folder(spark, "arrivals")
    ClassificationRun(models=["logistic"]).fit(t, "target", ["o_orderkey"]).save(f"{folder}/run")
    rows, n = t.drop("target"), []
    rows.where("o_orderkey % 2 = 0").write.parquet(f"{folder}/inbox")
    for call in range(3):
        if call == 2:
            rows.where("o_orderkey % 2 = 1").write.mode("append").parquet(f"{folder}/inbox")
        n.append(score_arrivals(spark, f"{folder}/run", f"{folder}/inbox", rows.schema, f"{folder}/scored", f"{folder}/seen"))
    written = spark.read.parquet(f"{folder}/scored").agg(F.count(F.lit(1)).alias("written"), (F.count_distinct("o_orderkey") == F.count(F.lit(1))).alias("once"))
    return written.select(*[F.lit(x).cast("bigint").alias(c) for c, x in zip(("first", "again", "later"), n)], "written", "once")
