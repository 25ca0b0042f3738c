"""Stored profiles: merged halves against the whole, replaced batches, odd tables and types."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from loomwork.operators import sketches as sk


def _wide(spark, n=30_000):
    return spark.range(n, numPartitions=6).select(
        "id", (F.col("id") % 1000 / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("name "), F.col("id") % 300)).alias("t"),
        F.when(F.col("id") % 4 > 0, 1e9 + F.col("id") % 3).otherwise(float("nan")).alias("big"), F.when(F.col("id") % 2 == 0, "").otherwise("é").alias("short"))


def test_parts_equal_the_whole(spark, tmp_path):
    df, path = _wide(spark), str(tmp_path / "states")
    sk.store_state(df.where("id % 3 = 0"), path, "b")  # replaced below
    sk.store_state(df.where("id < 100"), path, "a")
    sk.store_state(df.where("id >= 100 and id < 20000"), path, "b")
    sk.store_state(df.where("id >= 20000"), path, "c")
    sk.store_state(df.where("false"), path, "empty")
    got = {r["column"]: r for r in sk.stored_profile(spark, path).collect()}
    want = {r["column"]: r for r in sk.described(sk.profile_state(df)).collect()}
    assert set(got) == set(want) == set(df.columns)
    for c in df.columns:
        g, w = got[c], want[c]
        for name in ("rows", "missing", "low", "high", "longest", "missing_share"):
            assert g[name] == w[name], (c, name)
        for name in ("mean", "std", "mean_length"):
            assert g[name] == (None if w[name] is None else pytest.approx(w[name], rel=1e-9)), (c, name)
    exact = df.agg(*[F.count_distinct(F.when(~F.col(c).cast("string").isin("NaN", ""), F.col(c))).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert abs(got[c]["distinct"] - exact[c]) <= max(0.04 * exact[c], 0), c
    for q, v in zip(sk.QUANTILES, got["id"]["quantiles"]):
        assert abs(v / 30_000 - q) < 0.01
    assert got["big"]["std"] == pytest.approx((2 / 3) ** 0.5, rel=1e-2) and got["short"]["missing"] == 15_000
    only = {r["column"]: r["rows"] for r in sk.stored_profile(spark, path, ["a", "c"]).collect()}
    assert set(only.values()) == {100 + 10_000}
    assert {r["column"] for r in sk.columns_to_keep(sk.stored_profile(spark, path), 0.24).collect()} == {"id", "x", "t"}


def test_odd_tables_and_types(spark):
    empty = sk.described(sk.profile_state(spark.createDataFrame([], "a int, b string"))).collect()
    assert [(r["rows"], r["missing"], r["distinct"], r["quantiles"], r["missing_share"], r["mean_length"]) for r in empty] == [(0, 0, 0, None, None, None)] * 2
    nothing = sk.described(sk.profile_state(spark.createDataFrame([(None, None)] * 3, "a double, b string"))).collect()
    assert [(r["missing"], r["mean"], r["quantiles"], r["distinct"]) for r in nothing] == [(3, None, None, 0)] * 2
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(day, True, [1, 2], {"k": 1}, bytearray(b"x"), decimal.Decimal("1.50"), (1, "a")), (day, False, [2, 1], {"k": 1}, bytearray(b"x"), None, (1, "a"))],
                               "d date, f boolean, l array<int>, `m.1` map<string,int>, y binary, z decimal(5,2), `rows` struct<a:int,b:string>")
    got = {r["column"]: r for r in sk.described(sk.profile_state(df)).collect()}
    assert {c: r["distinct"] for c, r in got.items()} == {"d": 1, "f": 2, "l": 2, "m.1": 1, "y": 1, "z": 1, "rows": 1}
    assert got["z"]["low"] == got["z"]["high"] == 1.5 and got["z"]["missing"] == 1 and got["d"]["quantiles"] is None
    assert sk.profile_state(df, []).count() == 0
