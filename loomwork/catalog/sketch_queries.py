"""Queries of stored profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwork.catalog.inputs import rounded, table
from loomwork.catalog.registry import query
from loomwork.operators import sketches as sk
from loomwork.session import shared_dir

_NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TEXTS = ["l_returnflag", "l_linestatus"]
#: Five standard errors of the distinct estimate, and twice the error of a rank.
_DISTINCT_ERROR, _RANK_ERROR = 0.04, 0.01


def _input(spark, sf):
    """lineitem with missing taxes."""
    return table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))


def _stored(spark, sf):
    """Profile out of three stored batches, the middle one written twice."""
    path, t = f"{shared_dir(spark)}/profiles/{uuid.uuid4().hex}", _input(spark, sf)
    year = F.year("l_shipdate")
    for batch, rows in (("a", year < 1997), ("b", year < 2000), ("b", (year >= 1997) & (year < 2000)), ("c", year >= 2000)):
        sk.store_state(t.where(rows), path, batch, _NUMBERS + _TEXTS)
    return sk.stored_profile(spark, path)


_EXACT = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, "
     f"round(stddev_pop({c}), 4) AS std, NULL::DOUBLE AS mean_length, NULL::BIGINT AS longest FROM t" for c in _NUMBERS]
    + [f"SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, round(avg(length({c})), 4), max(length({c})) FROM t" for c in _TEXTS])


@query("prj10_stored_profile", f"WITH t AS (SELECT * REPLACE (nullif(l_tax, 0) AS l_tax) FROM lineitem) SELECT \"column\", rows, missing, low, high, mean, std, "
       f"mean_length, longest FROM ({_EXACT})")
def _(spark, sf):
    return rounded(_stored(spark, sf), 4, "mean", "std", "mean_length").select("column", "rows", "missing", "low", "high", "mean", "std", "mean_length", "longest")


@query("agg2_stored_distinct", "WITH t AS (SELECT * REPLACE (nullif(l_tax, 0) AS l_tax) FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS within FROM t" for c in _NUMBERS + _TEXTS))
def _(spark, sf):
    """Distinct estimates of the merged sketches beside the exact numbers."""
    names = _NUMBERS + _TEXTS
    exact = _input(spark, sf).agg(*[F.count_distinct(c).alias(c) for c in names]).unpivot([], names, "column", "exact")
    both = _stored(spark, sf).join(exact, "column")
    return both.select("column", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * _DISTINCT_ERROR)).alias("within"))


@query("rgm9_stored_quantiles", "WITH t AS (SELECT * REPLACE (nullif(l_tax, 0) AS l_tax) FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS place, count({c}) AS n, true AS within FROM t" for c in _NUMBERS for i in range(len(sk.QUANTILES))))
def _(spark, sf):
    """The share of rows below and up to every estimated quantile encloses the wanted share within the stated error."""
    found = _stored(spark, sf).where(F.col("quantiles").isNotNull()).select("column", F.posexplode("quantiles").alias("place", "q"))
    long = _input(spark, sf).select(*[F.col(c).cast("double") for c in _NUMBERS]).unpivot([], _NUMBERS, "column", "v").where("v is not null")
    counted = long.join(F.broadcast(found), "column").groupBy("column", "place").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("q")).alias("below"), F.count_if(F.col("v") <= F.col("q")).alias("upto"))
    wanted = F.element_at(F.array(*[F.lit(q) for q in sk.QUANTILES]), F.col("place") + 1)
    return counted.select("column", "place", "n", ((F.col("below") / F.col("n") <= wanted + _RANK_ERROR) & (F.col("upto") / F.col("n") >= wanted - _RANK_ERROR)).alias("within"))
