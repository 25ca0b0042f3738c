"""Rows of large partitions are dealt anew before a forest is fitted."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomwork import session
from loomwork.operators import features as fs
from loomwork.operators import models


def test_large_partitions_are_dealt_anew(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 1)
    assert session.spread(df) is df
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    dealt = session.spread(df)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and dealt.distinct().count() == 1000
    assert session.spread(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["forest", "importances"])
def test_forests_are_fitted_on_spread_rows(spark, monkeypatch, kind):
    df = spark.range(0, 300, 1, 1).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label"))
    seen = []
    module = models if kind == "forest" else fs
    monkeypatch.setattr(module, "spread", lambda rows: seen.append(rows.columns) or rows)
    if kind == "forest":
        models.estimator("regression", "random_forest", {"numTrees": 2}).fit(df.withColumn("features", array_to_vector(F.array("a"))))
    else:
        fs.forest_importances(df, ["a"], "label")
    assert seen == [["label", "features"]]
