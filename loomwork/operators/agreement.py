"""How far two clusterings of the same rows agree, corrected for chance.

Rows are counted once per pair of labels; everything after that works on these counts. The adjusted Rand index comes from
pairs of rows, mutual information from the counts, and its expected value under random labels from the hypergeometric law
of every pair of cluster sizes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.models import estimator
from loomwork.operators.split import assign_fold
from loomwork.session import stage

MEASURES = ["rand", "adjusted_rand", "mutual_information", "normalised_mutual_information", "adjusted_mutual_information", "homogeneity", "completeness"]
#: The hypergeometric law is summed within this many times the root of the smaller cluster around its mean; what lies beyond
#: has a probability below 2 exp(-2 * REACH ** 2) (Hoeffding's bound).
REACH = 5.0


def expected_information(x: int, y: int, n: int) -> float:
    """Expected contribution of clusters with x and y of n rows to the mutual information of random labels."""
    half, mean = REACH * np.sqrt(min(x, y)) + 1, float(x) * y / n
    low, high = max(0, x + y - n, int(mean - half)), min(x, y, int(mean + half) + 1)
    v = np.arange(low, high + 1, dtype=float)
    ratios = np.log(x - v[:-1]) + np.log(y - v[:-1]) - np.log(v[:-1] + 1) - np.log(n - x - y + v[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    law = np.exp(logs - logs.max())
    law /= law.sum()
    some = v > 0
    return float((law[some] * v[some] / n * (np.log(v[some]) + np.log(n) - np.log(x) - np.log(y))).sum())


def _expected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        each = [expected_information(x, y, n) * times for x, y, n, times in zip(f["x"], f["y"], f["n"], f["times"])]
        yield pd.DataFrame({"_g": f["_g"], "expected": np.array(each, float)})


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log(n / total))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def agreement(rows: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """Per group (or once) the number of rows and ``MEASURES`` of the labels in columns ``a`` and ``b``.

    Rows that lack either label are left out; noise is a cluster like any other, so drop it first where it should not count.
    Two clusterings without any structure (one cluster each, or single rows each) agree fully. Without rows there is no result
    row. The expected information takes one row per pair of different cluster sizes in a group.
    """
    groups = groups or []
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    whole = F.struct(*groups) if groups else F.lit(0)
    cells = stage(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(key.alias("_g"), F.col(a).alias("_a"), F.col(b).alias("_b"))
                  .agg(F.count(F.lit(1)).alias("c"), F.first(whole).alias("_of")), "cells")
    of_a = stage(cells.groupBy("_g", "_a").agg(F.sum("c").alias("x")), "sizes")
    of_b = stage(cells.groupBy("_g", "_b").agg(F.sum("c").alias("y")), "sizes")
    total = cells.groupBy("_g").agg(F.sum("c").alias("n"), F.sum(_pairs(F.col("c"))).alias("both"), F.first("_of").alias("_of"))
    first = of_a.join(total.select("_g", "n"), "_g").groupBy("_g").agg(_entropy(F.col("x"), F.col("n")).alias("ha"), F.sum(_pairs(F.col("x"))).alias("pa"))
    second = of_b.join(total.select("_g", "n"), "_g").groupBy("_g").agg(_entropy(F.col("y"), F.col("n")).alias("hb"), F.sum(_pairs(F.col("y"))).alias("pb"))
    shared = F.col("c") / F.col("n") * (F.log(F.col("c")) + F.log(F.col("n")) - F.log(F.col("x")) - F.log(F.col("y")))
    told = cells.join(of_a, ["_g", "_a"]).join(of_b, ["_g", "_b"]).join(total.select("_g", "n"), "_g").groupBy("_g").agg(F.sum(shared).alias("mi"))
    sizes = of_a.groupBy("_g", "x").agg(F.count(F.lit(1)).alias("nx")).join(of_b.groupBy("_g", "y").agg(F.count(F.lit(1)).alias("ny")), "_g")
    sizes = sizes.join(total.select("_g", "n"), "_g").select("_g", "x", "y", "n", (F.col("nx") * F.col("ny")).alias("times"))
    chance = sizes.repartition("_g", "x", "y").mapInPandas(_expected, "_g string, expected double").groupBy("_g").agg(F.sum("expected").alias("emi"))
    all_ = total.join(first, "_g").join(second, "_g").join(told, "_g").join(chance, "_g")
    n2, mi, mean = _pairs(F.col("n")), F.greatest("mi", F.lit(0.0)), (F.col("ha") + F.col("hb")) / 2
    by_chance = F.try_divide(F.col("pa") * F.col("pb"), n2)
    rand = F.try_divide(n2 + 2 * F.col("both") - F.col("pa") - F.col("pb"), n2)
    adjusted = (F.col("both") - by_chance) / ((F.col("pa") + F.col("pb")) / 2 - by_chance)
    # clusterings that leave chance no room: the denominators vanish up to rounding
    tight = (F.col("pa") + F.col("pb") == 0) | ((F.col("pa") == n2) & (F.col("pb") == n2))
    names = [F.col("_of")[g].alias(g) for g in groups]
    return all_.select(
        *names, F.col("n").alias("rows"), F.coalesce(rand, F.lit(1.0)).alias("rand"), F.when(tight, 1.0).otherwise(adjusted).alias("adjusted_rand"),
        mi.alias("mutual_information"), F.when(mean < 1e-12, 1.0).otherwise(mi / mean).alias("normalised_mutual_information"),
        F.when(tight, 1.0).otherwise((mi - F.col("emi")) / (mean - F.col("emi"))).alias("adjusted_mutual_information"),
        F.when(F.col("ha") < 1e-12, 1.0).otherwise(mi / F.col("ha")).alias("homogeneity"), F.when(F.col("hb") < 1e-12, 1.0).otherwise(mi / F.col("hb")).alias("completeness"))


def agreement_of_all(rows: DataFrame, labels: list[str], groups: list[str] | None = None) -> DataFrame:
    """(groups, first, second, rows, measures) for every pair of the label columns, in one pass over the rows."""
    groups = groups or []
    pairs = F.array(*[F.struct(F.lit(p).alias("first"), F.lit(q).alias("second"), F.col(p).cast("string").alias("a"), F.col(q).cast("string").alias("b"))
                      for p, q in itertools.combinations(labels, 2)])
    return agreement(rows.select(*groups, F.inline(pairs)), "a", "b", [*groups, "first", "second"])


def cluster_stability(name: str, df: DataFrame, keys: list[str], params: dict | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """Agreement of the clusterings that fits without one key-hash fold each give to all rows, one row per pair of fits.

    A clustering that hangs on the rows it was fitted on has a low adjusted index between its fits.
    """
    tagged = stage(assign_fold(df, keys, folds, seed, "_fold").select(*keys, "_fold", "features"), "folds")
    labelled, names = tagged.select(*keys, "features"), [f"fit{f}" for f in range(folds)]
    for f, label in enumerate(names):
        model = estimator("clustering", name, params).fit(tagged.where(F.col("_fold") != f))
        labelled = model.transform(labelled).drop("probability").withColumnRenamed("prediction", label)
    return agreement_of_all(labelled, names)
