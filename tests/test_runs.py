"""Whole runs on the small tables."""

import pytest
from pyspark.sql import functions as F

from loomwork.catalog.inputs import table
from loomwork.operators.score import score
from loomwork.plans.classification import ClassificationRun
from loomwork.plans.clustering import ClusteringRun
from loomwork.plans.regression import RegressionRun


@pytest.fixture(scope="module")
def orders(spark, data):
    return table(spark, data, "orders").withColumn("target", F.when(F.col("o_orderstatus") == "F", "final").otherwise("open")).drop("o_orderstatus")


def test_classification_run(spark, orders, tmp_path):
    year = F.year("o_orderdate")
    run = ClassificationRun(models=["logistic", "decision_tree"], tune="random", trials=2, cross_validation="always", folds=2).fit(
        orders.where(year <= 1999), "target", ["o_orderkey"], {"oot1": orders.where(year == 2000), "oot2": orders.drop("o_totalprice")})
    assert {r["dataset"] for r in run.metrics.select("dataset").distinct().collect()} == {"train", "valid", "test", "oot1"}
    assert {(r["dataset"], r["usable"]) for r in run.prepared.holdout_report.collect()} == {("oot1", True), ("oot2", False)}
    assert run.ranking.where("role = 'Champion'").count() == 1
    assert run.cross_validation.count() == 4 and run.decisions.count() == 2
    assert "o_orderdate" not in run.prepared.spec.raw
    new = orders.where(year == 2001).drop("target")
    live = {r["o_orderkey"]: r["predicted_class"] for r in run.predict(new).collect()}
    assert set(live.values()) <= {"final", "open"} and len(live) == new.count()
    run.save(str(tmp_path / "run"))
    again = score(str(tmp_path / "run"), new, str(tmp_path / "out"))
    assert {r["o_orderkey"]: r["predicted_class"] for r in again.collect()} == live


@pytest.mark.parametrize("balance, tune", [("oversample", "halving"), ("smote", "adaptive")])
def test_balanced_run_judges_untouched_folds(spark, orders, balance, tune):
    rare = orders.where("target = 'final' or o_orderkey % 25 = 0")  # few open orders
    run = ClassificationRun(models=["decision_tree"], tune=tune, trials=3, balance=balance, imbalance_threshold=0.2, cross_validation="always", folds=2).fit(
        rare.drop("o_orderdate"), "target", ["o_orderkey"])
    whole = run.prepared.rows.where(F.col("dataset").isin("train", "valid", "test"))
    assert run.prepared.train.count() > whole.where("dataset = 'train'").count()
    assert run.cross_validation.count() == 2 and run.cross_validation.where("folds = 2 and mean between 0 and 1").count() == 2
    assert run.trials["decision_tree"].where("best").count() == 1


def test_regression_run(spark, data):
    part = table(spark, data, "part")
    run = RegressionRun(models=["linear_regression", "decision_tree"]).fit(part, "p_retailprice", ["p_partkey"])
    assert run.metrics.count() == 2 * 3 * 6
    tables = run.diagnostics("valid")
    assert tables["histogram"].agg(F.sum("n")).first()[0] == run.prepared.dataset("valid").count()
    assert {"residual", "absolute_error"} <= set(run.predict(part.withColumn("actual", F.col("p_retailprice"))).columns)


def test_clustering_run(spark, data):
    customer = table(spark, data, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    run = ClusteringRun(models=["kmeans", "dbscan"], ks=[2, 3, 4], density_grid=([0.5, 1.0], [3])).fit(customer, ["c_custkey"])
    assert run.labelled().count() == customer.count()
    assert run.sweeps["kmeans"].count() == 3 and run.sweeps["dbscan"].count() >= 2
    profile = run.profile()
    assert profile["numeric"].agg(F.sum("count")).first()[0] == customer.count()
    assert set(profile) == {"insights", "numeric", "distinctive", "categorical", "dominant"}


def test_density_run_clusters_new_rows_anew(spark, data):
    customer = table(spark, data, "customer").select("c_custkey", "c_acctbal")
    run = ClusteringRun(models=["dbscan"], density_grid=([0.1], [3])).fit(customer, ["c_custkey"])
    assert run.champion == "dbscan"
    again = {r["c_custkey"]: r["prediction"] for r in run.predict(customer).collect()}
    assert again == {r["c_custkey"]: r["cluster"] for r in run.labelled().collect()}
    with pytest.raises(ValueError):
        run.save("unused")


def test_balanced_run_adds_synthetic_rows_over_categories(spark, orders):
    run = ClassificationRun(models=["decision_tree"], balance="smote", imbalance_threshold=0.9, max_ratio=1.0).fit(
        orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "target"), "target", ["o_orderkey"])
    assert run.prepared.spec.categorical == ["o_orderpriority"]
    before = {r["label"]: r["count"] for r in run.prepared.dataset("train").groupBy("label").count().collect()}
    after = {r["label"]: r["count"] for r in run.prepared.train.groupBy("label").count().collect()}
    assert before[0.0] != before[1.0] and set(after.values()) == {max(before.values())}
    assert run.predict(orders.drop("target")).count() == orders.count()


def test_library_stays_on_executors():
    """No whole-table transfer to the driver, no cross join, no local checkpoint, no row-at-a-time code in the package."""
    import pathlib

    import loomwork
    text = "".join(p.read_text() for p in pathlib.Path(loomwork.__file__).parent.rglob("*.py"))
    for word in ("toPandas", "crossJoin", "localCheckpoint", ".rdd"):
        assert word not in text, word


def test_plans_join_by_keys(spark, data):
    """No product of two tables in the plans of queries that put tables side by side or compare rows."""
    import __spark_entry__ as entry
    for name in ("fsl5_selection_sample", "joi4_index_exact_neighbours", "joi4_nearest_neighbours", "tun4_cross_validation_holds", "prj1_missing_counts"):
        if name in entry.queries():
            plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_row_beside_a_table(spark):
    from loomwork.session import with_row
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, `odd.name` string")
    row = df.agg({"x": "max"}).withColumnRenamed("max(x)", "most")
    assert sorted(map(tuple, with_row(df, row).collect())) == [(1, "a", 2), (2, "b", 2)]
