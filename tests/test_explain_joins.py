"""The draws of an explanation are joined without a broadcast of them."""

from pyspark.sql import functions as F

from loomwork.operators import explain as ex


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_never_broadcast(spark, monkeypatch):
    rows = spark.range(500).select("id", (F.col("id") % 13).alias("a"), (F.col("id") % 7).alias("b"))
    small = ex.background_draws(rows, rows, ["a", "b"], ["id"], 8)
    assert "BroadcastHashJoin" in _plan(small)
    monkeypatch.setattr(ex, "BACKGROUND_DOUBLES", 100)
    large = ex.background_draws(rows, rows, ["a", "b"], ["id"], 8)
    assert "BroadcastHashJoin" not in _plan(large) and "SortMergeJoin" in _plan(large)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
