"""Agreement of clusterings against counts of row pairs and the mean over all ways to deal the labels."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from loomwork.operators.agreement import agreement, agreement_of_all, expected_information


def _information(a, b):
    n = len(a)
    return sum(c / n * math.log(n * c / (a.count(x) * b.count(y))) for x in set(a) for y in set(b) if (c := sum(p == (x, y) for p in zip(a, b))))


def test_expected_information_is_the_mean_over_all_orders():
    a, b = [0, 0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 1, 1, 2]
    orders = list(itertools.permutations(b))
    want = sum(_information(a, list(o)) for o in orders) / len(orders)
    got = sum(expected_information(a.count(x), b.count(y), len(a)) for x in set(a) for y in set(b))
    assert got == pytest.approx(want, abs=1e-12)


def test_wide_sizes_match_the_whole_law():
    n, x, y = 60_000, 25_000, 31_000
    lg = math.lgamma
    fixed = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
    want = sum(v / n * math.log(n * v / (x * y)) * math.exp(fixed - lg(v + 1) - lg(x - v + 1) - lg(y - v + 1) - lg(n - x - y + v + 1))
               for v in range(1, x + 1))
    assert expected_information(x, y, n) == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_groups_and_plain_cases(spark):
    rows = [("same", 1, "x"), ("same", 1, "x"), ("same", 2, "y"), ("same", 2, "y"), ("one", 1, "x"), ("one", 1, "x"), ("one", 1, "x"),
            ("single", 1, "x"), ("single", 2, "y"), ("cross", 1, "x"), ("cross", 1, "y"), ("cross", 2, "x"), ("cross", 2, "y"), ("alone", 1, "x"),
            (None, 1, "x"), (None, 1, "y"), (None, 2, "y"), (None, None, "y"), (None, 2, None)]
    got = {r["g"]: r for r in agreement(spark.createDataFrame(rows, "g string, a int, b string"), "a", "b", ["g"]).collect()}
    for g in ("same", "one", "single", "alone"):
        assert [got[g][m] for m in ("adjusted_rand", "adjusted_mutual_information", "homogeneity")] == pytest.approx([1.0] * 3), g
    assert got["cross"]["adjusted_rand"] == pytest.approx(-0.5) and got["cross"]["mutual_information"] == 0 and got["cross"]["rand"] == pytest.approx(1 / 3)
    assert got[None]["rows"] == 3 and got[None]["rand"] == pytest.approx(1 / 3)
    assert agreement(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []


def test_all_pairs(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("p"), (F.col("id") % 3 + 5).alias("q"), (F.col("id") % 4).alias("r"))
    got = {(r["first"], r["second"]): r["adjusted_rand"] for r in agreement_of_all(df, ["p", "q", "r"]).collect()}
    assert got["p", "q"] == pytest.approx(1.0) and got["p", "r"] == got["q", "r"] < 0
