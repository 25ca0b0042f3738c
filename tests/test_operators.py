"""Operators against brute force on small fixtures, skew included."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions.columns import hash_code, normal_quantile
from loomwork.operators import classification_metrics as cm
from loomwork.operators import clustering_metrics as cu
from loomwork.operators import encode as en
from loomwork.operators import explain as ex
from loomwork.operators import features as fs
from loomwork.operators import profile as pf
from loomwork.operators import rank as rk
from loomwork.operators import smote as sm
from loomwork.operators import split as sp
from loomwork.operators import tune as tn
from loomwork.operators.dbscan import connected_components, dbscan
from loomwork.operators.models import available_models, estimator, hidden_width
from loomwork.operators.spatial import nearest_neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one group and one value."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 5}", 1.0 if i % 3 == 0 else float((i * 37) % 101)) for i in range(900)]
    return spark.createDataFrame(rows, "k bigint, g string, v double")


@pytest.mark.parametrize("width", [1, 4, 16])
def test_position_and_ntile_equal_windows(spark, skewed, width):
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        order = [F.col("v").desc(), F.col("k")]
        w = Window.partitionBy("g").orderBy(*order)
        want = skewed.select("k", F.row_number().over(w).alias("rn"), F.ntile(7).over(w).alias("t"))
        got = rk.with_group_position(skewed, ["g"], order)
        tiles = rk.with_ntile(skewed, ["g"], order, 7, "t").select("k", "t")
        both = got.select("k", "rn").join(tiles, "k")
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_ntile_of_fewer_rows_than_tiles(spark):
    df = spark.range(4).select("id")
    got = [r["decile"] for r in rk.with_ntile(df, [], [F.col("id")], 10).orderBy("id").collect()]
    assert got == [1, 2, 3, 4]


@pytest.mark.parametrize("width", [1, 5, 16])
def test_quantiles_of_hot_group(spark, skewed, width):
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = {r["g"]: (r["a"], r["b"], r["c"]) for r in rk.exact_quantiles(skewed, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.9}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(tuple(np.quantile(part.v, [0.0, 0.37, 0.9])), abs=1e-9)


def test_running_sums_per_group(spark, skewed):
    counts = skewed.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r["g"], r["v"]): (r["n_cum"], r["n_total"]) for r in rk.running_sums(counts, ["g"], [F.col("v")], ["n"]).collect()}
    pdf = counts.toPandas().sort_values(["g", "v"])
    pdf["cum"] = pdf.groupby("g").n.cumsum()
    pdf["tot"] = pdf.groupby("g").n.transform("sum")
    assert got == {(r.g, r.v): (r.cum, r.tot) for r in pdf.itertuples()}


def test_areas_equal_spark_evaluator(spark, skewed):
    df = skewed.select("k", (F.col("k") % 4 == 0).cast("double").alias("label"), (F.col("v") / 101).alias("score"))
    raw = df.withColumn("rawPrediction", F.col("score"))
    roc = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    pr = BinaryClassificationEvaluator(numBins=0, metricName="areaUnderPR").evaluate(raw)
    assert cm.area_under_roc(df).first()["roc"] == pytest.approx(roc, abs=1e-12)
    assert cm.area_under_pr(df).first()["pr"] == pytest.approx(pr, abs=1e-12)
    long = cm.metric_matrix(df.withColumns({"dataset": F.lit("train"), "prediction": F.lit(0.0)}), ["k"], ["dataset"], ["train", "oot1"])
    values = {(r["dataset"], r["metric"]): r["value"] for r in long.collect()}
    assert values["train", "roc"] == pytest.approx(roc, abs=1e-12)
    assert values["oot1", "roc"] == 0.0 and values["train", "accuracy"] == pytest.approx(0.75)


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 1.0, 0.3), (2, 1.0, 0.4)], "k int, label double, score double")
    assert cm.area_under_roc(df).first()["roc"] is None


def test_silhouette_equals_spark_evaluator(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)], int(i % 4)) for i in range(200)] + [(999, [9.0, 9.0, 9.0], 7)]
    df = spark.createDataFrame(rows, "k int, x array<double>, prediction int").withColumn("features", array_to_vector("x"))
    assert cu.silhouette(df).first()["silhouette"] == pytest.approx(ClusteringEvaluator().evaluate(df), abs=1e-9)


def test_centres_in_several_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3)], int(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x array<double>, prediction int").withColumn("features", array_to_vector("x"))
    want = cu.all_indices(df).first().asDict()
    monkeypatch.setattr(cu, "CENTRE_DOUBLES", 12)
    assert cu.all_indices(df).first().asDict() == pytest.approx(want, abs=1e-9)


def test_noise_aware_silhouette_guards(spark):
    df = spark.createDataFrame([([0.0], 0), ([1.0], 0), ([5.0], 1), ([9.0], -1)], "x array<double>, prediction int")
    assert cu.noise_aware_silhouette(df.withColumn("features", array_to_vector("x"))).first()["silhouette"] == -1.0


def test_projection_equals_numpy(spark):
    x = np.random.default_rng(5).normal(size=(60, 4)) * [4, 2, 1, 0.5]
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "k int, a array<double>, prediction int")
    got = cu.project_2d(df.withColumn("features", array_to_vector("a")), ["k"]).orderBy("k").collect()
    _, vec = np.linalg.eigh(np.cov(x.T))
    top = vec[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(0), range(2)])
    assert np.allclose([[r["x"], r["y"]] for r in got], x @ top, atol=1e-8)


def _brute_neighbours(x, k):
    d2 = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1]))
    np.fill_diagonal(d2, np.inf)
    return [list(np.lexsort((np.arange(len(x)), d2[i]))[:min(k, len(x) - 1)]) for i in range(len(x))]


@pytest.mark.parametrize("n,width,capacity", [(600, 2, 12), (300, 4, 14), (6, 2, None)])
def test_neighbours_equal_brute_force(spark, n, width, capacity):
    x = np.round(np.random.default_rng(n).normal(size=(n, width)) * 2, 1)
    if n > 10:
        x[: n // 3] = x[0]  # a third of the rows are copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    got = [[] for _ in range(n)]
    for r in nearest_neighbours(df, width, 5, capacity).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    assert got == _brute_neighbours(x, 5)


def _brute_clusters(x, eps, least):
    z = (x - x.mean(0)) / x.std(0)
    near = sum((z[:, None, i] - z[None, :, i]) ** 2 for i in range(z.shape[1])) <= eps * eps
    core, label, count = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], count
            while stack:
                for v in np.flatnonzero(near[stack.pop()] & core):
                    if label[v] < 0:
                        label[v] = count
                        stack.append(v)
            count += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return label, core


@pytest.mark.parametrize("n,width,eps,least,capacity", [(450, 2, 0.2, 5, 8), (300, 4, 0.8, 4, 6)])
def test_density_clusters_equal_brute_force(spark, n, width, eps, least, capacity):
    rng = np.random.default_rng(n)
    third = n // 3
    x = np.vstack([rng.normal(size=(third, width)) * 0.3, rng.normal(size=(third, width)) + 3, rng.uniform(-3, 6, size=(n - 2 * third, width))])
    x[: n // 4] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k bigint, a array<double>")
    out = dbscan(df.select("k", array_to_vector("a").alias("features")), ["k"], eps, least, capacity=capacity)
    label, core = _brute_clusters(x, eps, least)
    assert {r["k"]: (r["prediction"], r["core"]) for r in out.collect()} == {i: (label[i], bool(core[i])) for i in range(n)}


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    vertices = sorted({v for e in links for v in e} | {500})
    got = connected_components(spark.createDataFrame([(v,) for v in vertices], "v bigint"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["v"]: r["root"] for r in got.collect()} == {v: 0 if v <= 40 else 500 if v == 500 else 100 for v in vertices}


def test_synthetic_rows_lie_between_parents(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", float(rng.normal()), int(rng.integers(0, 50)), 1 if i < 12 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, a double, b bigint, y int")
    out = sm.smote(df, "y", ["a", "b"], ["key"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 188, 1: 56}
    assert out.schema == df.schema
    minority = np.array([[r[1], r[2]] for r in rows[:12]])
    lows, highs = minority.min(0), minority.max(0)
    fresh = out.where("y = 1 AND key LIKE '%#%'").collect()
    assert len(fresh) == 44 and len({r["key"] for r in fresh}) == 44
    near = _brute_neighbours(minority, 5)
    for r in fresh:
        base = int(r["key"].split("#")[0][1:])
        ok = False
        for j in near[base]:
            p, q = minority[base], minority[j]
            alpha = (r["a"] - p[0]) / (q[0] - p[0]) if q[0] != p[0] else 0.0
            ok |= -1e-9 <= alpha <= 1 + 1e-9 and abs(r["b"] - (p[1] + alpha * (q[1] - p[1]))) <= 0.5 + 1e-9
        assert ok and (lows <= [r["a"], r["b"]]).all() and ([r["a"], r["b"]] <= highs).all()


def test_tiny_class_is_repeated(spark):
    df = spark.createDataFrame([(i, float(i), 1 if i < 3 else 0) for i in range(100)], "key bigint, a double, y int")
    out = sm.smote(df, "y", ["a"], ["key"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 97, 1: 29}


def test_splits_cover_and_do_not_overlap(spark, skewed):
    parts = sp.split_frames(skewed, ["k"], {"train": 2, "valid": 1, "test": 1})
    keys = [{r["k"] for r in p.collect()} for p in parts.values()]
    assert len(set.union(*keys)) == 900 == sum(map(len, keys))
    again = sp.split_frames(skewed.repartition(7), ["k"], {"train": 2, "valid": 1, "test": 1})
    assert keys == [{r["k"] for r in p.collect()} for p in again.values()]


def test_scaler_has_unit_deviation(spark, skewed):
    out = en.standardised(skewed, {}, ["v"])["train"]
    from pyspark.ml.functions import vector_to_array
    assert out.agg(F.stddev_samp(vector_to_array("features")[0])).first()[0] == pytest.approx(1.0)


def test_unknown_category_and_missing_column(spark):
    spec = en.FeatureSpec(None, categorical=["c"], numeric=["n"])
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "c string, n double")
    model = en.fit_encoder(en.prepare_columns(train, spec), spec, scale=False)
    new = spark.createDataFrame([("zzz", None), (None, float("nan"))], "c string, n double")
    assert [list(r["features"]) for r in model.transform(en.prepare_columns(new, spec)).collect()] == [[2.0, 0.0], [2.0, 0.0]]
    with pytest.raises(ValueError):
        en.prepare_columns(new.drop("n"), spec)


def test_name_rules():
    cols = ["x_a", "x_b", "y_a", "t"]
    assert pf.feature_names(cols, "t", include_prefix=["x_"], exclude_suffix=["_b"]) == ["x_a"]
    assert pf.feature_names(cols, "t", include_prefix=["x_", "y_"], include_suffix=["_a"]) == ["x_a", "y_a"]


def test_two_valued_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 5), (1, "x", "b", 6), (1, "x", "c", 5)], "one int, n string, three string, two int")
    assert {r["column"] for r in pf.two_valued(df).collect()} == {"n", "two"}
    assert pf.suggest_target(df, "classification").first()["column"] == "n"
    assert pf.suggest_target(df, "regression").first()["column"] == "one"


def test_hash_code_keeps_sign_and_marks_missing(spark):
    df = spark.createDataFrame([("R",), ("A",), ("N",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(hash_code(F.col("c"))).collect()] == [-844871, -738094, 152512, -999, -999]
    assert all(r[0] >= 0 or r[0] == -999 for r in df.select(hash_code(F.col("c"), True)).collect())


def test_normal_quantile(spark):
    from statistics import NormalDist
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_contributions_add_up(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, *[float(v) for v in rng.normal(size=3)]) for i in range(40)], "k bigint, a double, b double, c double")
    feats = ["a", "b", "c"]
    va = VectorAssembler(inputCols=feats, outputCol="features")
    rows = va.transform(df.withColumn("label", F.col("a") * 3 + F.col("b") * F.col("b")))
    model = PipelineModel(stages=[va, estimator("regression", "decision_tree").fit(rows)])
    phi = ex.shapley_values(model, df, df, feats, ["k"], background_rows=40)
    sums = {r["k"]: r["s"] for r in phi.groupBy("k").agg(F.sum("phi").alias("s")).collect()}
    fitted = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    mean = sum(fitted.values()) / len(fitted)
    assert sums == pytest.approx({k: v - mean for k, v in fitted.items()}, abs=1e-6)
    assert ex.mean_absolute(phi).count() == 3


def test_search_spaces():
    assert len(tn.draw_params({"a": [1, 2], "b": (3, 4)}, 50)) == 4
    assert tn.draw_params({"a": (0.0, 1.0)}, 3, 7) == tn.draw_params({"a": (0.0, 1.0)}, 3, 7)
    assert len(tn.grid_params(tn.GRIDS["classification"]["logistic"])) == 80
    assert "gradient_boosting" not in available_models("classification", 3)
    assert [hidden_width(n) for n in (10, 20, 21)] == [8, 16, 32]


def test_wide_tables_are_filtered(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2) * 2, 1.0, float(i)) for i in range(50)], "y double, good double, flat double, noise double")
    kept = fs.statistical_filter(df, ["good", "flat", "noise"], "y", 2)
    assert [r["feature"] for r in kept.collect()] == ["good", "noise"]


def test_a_density_trial_joins_the_rows_once(spark, monkeypatch):
    from loomwork.operators import dbscan as density
    rows = [(i, [float(i % 2) * 9 + i % 7 * 0.01, float(i % 3) * 0.01]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a array<double>").select("k", array_to_vector("a").alias("features"))
    plans, stage = [], density.stage

    def watched(frame, label):
        if label == "trial":
            plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return stage(frame, label)

    monkeypatch.setattr(density, "stage", watched)
    best, trials = density.dbscan_search(df, ["k"], eps_values=[0.3], min_points_values=[5])
    found = {(r["k"] % 6, r["prediction"]) for r in best.collect()}
    assert trials.count() == 1 and best.count() == 200 and len(found) == 6 and len({p for _, p in found}) == 6
    assert [sum("Relation [k#" in line for line in p.splitlines()) for p in plans] == [1]
