"""Queries of the searches that learn from earlier trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.catalog.model_queries import _parts
from loomwork.catalog.profile_queries import sql_bucket
from loomwork.catalog.registry import query
from loomwork.operators.adaptive import PART_SEED, adaptive_search, halving_search, rung_rows

_RUNGS = (0.25, 0.5, 1.0)
_B = sql_bucket("p_partkey::VARCHAR", PART_SEED)


@query("tun2_halving_rungs", f"SELECT p_partkey, CASE WHEN b < 0.25 THEN 0 WHEN b < 0.5 THEN 1 ELSE 2 END AS first_rung, true AS nested FROM (SELECT p_partkey, {_B} AS b FROM part)")
def _(spark, sf):
    """The first rung that holds a row; every later one holds it too."""
    rows = _parts(spark, sf).select("p_partkey")
    held = None
    for i, share in enumerate(_RUNGS):
        part = rung_rows(rows, ["p_partkey"], share).withColumn("rung", F.lit(i))
        held = part if held is None else held.unionByName(part)
    return held.groupBy("p_partkey").agg(F.min("rung").alias("first_rung"), (F.count(F.lit(1)) == len(_RUNGS) - F.min("rung")).alias("nested"))


@query("tun2_halving_search", f"""
SELECT rung::INTEGER AS rung, trials::BIGINT AS trials, (SELECT count(*) FROM part WHERE {_B} < share) AS rows, true AS top_go_on
FROM (VALUES (0, 4, 0.25), (1, 2, 0.5), (2, 1, 1.0)) v(rung, trials, share)""")
def _(spark, sf):
    out = halving_search("clustering", "kmeans", _parts(spark, sf), keys=["p_partkey"], n=4, space={"k": [2, 3, 4, 5, 6]}, rungs=_RUNGS, survivors=0.5)
    rank = F.row_number().over(Window.partitionBy("rung").orderBy(F.col("score").desc(), "trial"))  # a row per trial
    size = F.count(F.lit(1)).over(Window.partitionBy("rung"))
    stay = F.when(F.col("rung") == len(_RUNGS) - 1, 1).otherwise(F.ceil(size * 0.5))
    return out.withColumn("right", F.col("kept") == (rank <= stay)).groupBy("rung").agg(
        F.count(F.lit(1)).alias("trials"), F.max("rows").alias("rows"), F.bool_and("right").alias("top_go_on"))


@query("tun1_adaptive_search", "SELECT count(*) AS n, 5::BIGINT AS trials, 3::BIGINT AS proposed, true AS distinct_trials, true AS best_is_top FROM part")
def _(spark, sf):
    rows = _parts(spark, sf)
    out = adaptive_search("clustering", "kmeans", rows, n=5, start=2, space={"k": [2, 3, 4, 5, 6], "maxIter": (5, 20)})
    return out.agg(
        F.lit(rows.count()).cast("bigint").alias("n"), F.count(F.lit(1)).alias("trials"), F.count_if("proposed").alias("proposed"),
        (F.count_distinct("params") == F.count(F.lit(1))).alias("distinct_trials"), (F.max(F.when(F.col("best"), F.col("score"))) == F.max("score")).alias("best_is_top"))
