"""Searches that learn from earlier trials."""

import json
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomwork.operators import adaptive as ad

SPACE = {"a": (0.0, 1.0), "k": (1, 9), "c": ["x", "y", "z"]}


def _worth(p):
    return -(p["a"] - 0.3) ** 2 - (p["k"] - 7) ** 2 / 50 + (p["c"] == "y") / 4


def test_proposals_stay_in_the_space_and_near_good_trials():
    rng = random.Random(3)
    done = [(p, _worth(p)) for p in ad.draw_params(SPACE, 40, 1)]
    got = [ad.propose(SPACE, done, [], rng) for _ in range(40)]
    assert all(0 <= p["a"] <= 1 and p["k"] in range(1, 10) and isinstance(p["k"], int) and p["c"] in "xyz" for p in got)
    assert sum(map(_worth, got)) / 40 > sum(s for _, s in done) / 40 + 0.1
    worst = [ad.propose(SPACE, done, [], rng, larger=False) for _ in range(40)]
    assert sum(map(_worth, worst)) < sum(map(_worth, got))
    assert ad.propose(SPACE, done, [], random.Random(9)) == ad.propose(SPACE, done, [], random.Random(9))


def test_used_up_space():
    space = {"c": [1, 2]}
    assert ad.propose(space, [({"c": 1}, 0.0)], [{"c": 1}, {"c": 2}], random.Random(0)) is None
    assert ad._untried(space, [{"c": 2}], 5) == {"c": 1} and ad._untried(space, [{"c": 2}, {"c": 1}], 5) is None


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id") % 37
    return spark.range(900).select(F.col("id").alias("key"), (x + F.col("id") % 5 > 20).cast("double").alias("label"),
                                   array_to_vector(F.array(x.cast("double"), (F.col("id") % 5).cast("double"))).alias("features"))


def test_adaptive_search(rows):
    space = {"maxDepth": (1, 6), "minInstancesPerNode": [1, 400]}
    out = [r.asDict() for r in ad.adaptive_search("classification", "decision_tree", rows, n=8, start=4, space=space, keys=["key"], folds=2, parallelism=2).collect()]
    assert len(out) == 8 and len({r["params"] for r in out}) == 8 and [r["proposed"] for r in out] == [False] * 4 + [True] * 4
    assert [r["score"] for r in out if r["best"]] == [max(r["score"] for r in out)]
    few = ad.adaptive_search("classification", "decision_tree", rows, rows, n=8, space={"maxDepth": [1, 2, 3]}).collect()
    assert {json.loads(r["params"])["maxDepth"] for r in few} == {1, 2, 3} and len(few) == 3


def test_halving_search(rows):
    out = [r.asDict() for r in ad.halving_search("classification", "decision_tree", rows, rows, keys=["key"], n=6, space={"maxDepth": (1, 6)}, rungs=(0.1, 0.5, 1.0)).collect()]
    by = [[r for r in out if r["rung"] == i] for i in range(3)]
    assert [len(b) for b in by] == [6, 2, 1] and by[2][0]["rows"] == 900 and by[0][0]["rows"] < by[1][0]["rows"] < 900
    for here, nxt in zip(by, by[1:]):
        kept = sorted(here, key=lambda r: (-r["score"], r["trial"]))[:len(nxt)]
        assert {r["trial"] for r in kept} == {r["trial"] for r in nxt} == {r["trial"] for r in here if r["kept"]}
    assert [r["best"] for r in out] == [False] * 8 + [True]
    small, large = ad.rung_rows(rows, ["key"], 0.1), ad.rung_rows(rows, ["key"], 0.5)
    assert small.count() == by[0][0]["rows"] and small.join(large, "key", "left_anti").count() == 0
    with pytest.raises(ValueError):
        ad.halving_search("classification", "decision_tree", rows, rows, keys=["key"], rungs=(0.5, 0.1, 1.0))
