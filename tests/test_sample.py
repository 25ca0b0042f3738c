"""The distributed sample of a fixed number of rows equals an ordered limit."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import features as fs


@pytest.mark.parametrize("n", [0, 1, 999, 4000, 8999, 9000, 20_000])
def test_equals_ordered_limit(spark, monkeypatch, n):
    monkeypatch.setattr(fs, "EDGE_ROWS", 2)
    df = spark.range(9000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"), F.lit("x").alias("t"))
    got = fs.fit_sample(df, n).groupBy("id").count()
    want = df.orderBy(F.xxhash64(F.lit(42), "id", "t")).limit(n).groupBy("id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert fs.fit_sample(df, n).columns == ["id", "t"]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id long")
    assert fs.fit_sample(empty, 5).collect() == []
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "id long")
    assert fs.fit_sample(nulls, 2).count() == 2 and fs.fit_sample(nulls, None).count() == 3
    signs = spark.createDataFrame([(v,) for v in (-(1 << 63), -1, 0, 5, (1 << 63) - 1)], "id long")
    assert sorted(r[0] for r in fs.smallest(signs, F.col("id"), 3).collect()) == [-(1 << 63), -1, 0]
