"""Queries of histogram boosting and of exact tree explanations."""

from __future__ import annotations

import itertools
import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomwork.catalog.inputs import table
from loomwork.catalog.registry import query
from loomwork.operators.boosting import HistogramBoosting
from loomwork.operators.models import estimator
from loomwork.operators.tree_explain import Condition, Leaf, exact_shapley_values, model_leaves
from loomwork.session import stage

STEP, LAMBDA = 0.1, 1.0
_FEATURES = ["l_quantity", "l_discount", "l_tax", "CASE WHEN l_linenumber <> 7 THEN l_linenumber END"]  # the last has missing values


def _rows(spark, sf, label):
    """lineitem as label and features, NaN for missing."""
    x = F.array(*[F.coalesce(F.expr(f).cast("double"), F.lit(float("nan"))) for f in _FEATURES])
    return table(spark, sf, "lineitem").select(F.expr(label).cast("double").alias("label"), array_to_vector(x).alias("features"))


def _first_split_sql(label: str, classes: int, squared: bool = False) -> str:
    """First split and leaf values from the definition: gradient and hessian sums per value, running sums, gain of both sides of the missing values."""
    seen = "y" if classes == 1 else "(y = k)::INT"
    hessian = "1.0" if squared else "p * (1 - p)"
    parts = " UNION ALL ".join(f"SELECT k, {i} AS feature, f{i} AS v, g, h FROM s" for i in range(4))
    columns = ", ".join(f"({f})::DOUBLE AS f{i}" for i, f in enumerate(_FEATURES))
    return f"""WITH t AS (SELECT ({label})::DOUBLE AS y, {columns} FROM lineitem),
c AS (SELECT k, avg({seen}) AS p FROM t, range({classes}) r(k) GROUP BY k),
s AS (SELECT k, f0, f1, f2, f3, p - {seen} AS g, {hessian} AS h FROM t, c),
b AS (SELECT k, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({parts}) GROUP BY ALL),
a AS (SELECT k, feature, sum(g) AS ga, sum(h) AS ha, sum(n) AS na, max(v) AS top, coalesce(sum(g) FILTER (v IS NULL), 0) AS gm,
      coalesce(sum(h) FILTER (v IS NULL), 0) AS hm, coalesce(sum(n) FILTER (v IS NULL), 0) AS nm FROM b GROUP BY ALL),
r AS (SELECT k, feature, v, sum(g) OVER w AS gr, sum(h) OVER w AS hr, sum(n) OVER w AS nr FROM b WHERE v IS NOT NULL WINDOW w AS (PARTITION BY k, feature ORDER BY v)),
d AS (SELECT k, feature, CASE WHEN v = top THEN 'inf'::DOUBLE ELSE v END AS threshold, m AS missing_left, ga, ha, na,
      gr + CASE WHEN m THEN gm ELSE 0 END AS gl, hr + CASE WHEN m THEN hm ELSE 0 END AS hl, nr + CASE WHEN m THEN nm ELSE 0 END AS nl
      FROM r JOIN a USING (k, feature), (VALUES (false), (true)) x(m) WHERE NOT m OR nm > 0),
e AS (SELECT *, (gl * gl / (hl + {LAMBDA}) + (ga - gl) * (ga - gl) / (ha - hl + {LAMBDA}) - ga * ga / (ha + {LAMBDA})) / 2 AS gain
      FROM d WHERE nl > 0 AND nl < na)
SELECT k::INTEGER AS label, feature::INTEGER AS feature, threshold, missing_left, round(-{STEP} * gl / (hl + {LAMBDA}), 6) AS left_value,
       round(-{STEP} * (ga - gl) / (ha - hl + {LAMBDA}), 6) AS right_value
FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC) = 1"""


def _first_split(spark, sf, label, objective, classes=2):
    model = HistogramBoosting(objective=objective, classes=classes, maxIter=1, maxDepth=1, maxBins=200, stepSize=STEP, regLambda=LAMBDA).fit(_rows(spark, sf, label))
    n = model.nodes(spark)
    value = n.select("label", F.col("node").alias("child"), F.round("value", 6).alias("value"))
    inner = n.where("feature >= 0").select("label", "feature", "threshold", "missing_left", "left", "right")
    for side in ("left", "right"):
        inner = inner.join(value.withColumnsRenamed({"child": side, "value": f"{side}_value"}), ["label", side])
    return inner.select("label", "feature", "threshold", "missing_left", "left_value", "right_value")


_RETURNED = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
_FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


@query("mdl3_boosted_first_split", _first_split_sql(_RETURNED, 1))
def _(spark, sf):
    return _first_split(spark, sf, _RETURNED, "logistic")


@query("mdl3_boosted_multiclass_first_splits", _first_split_sql(_FLAG, 3))
def _(spark, sf):
    return _first_split(spark, sf, _FLAG, "softmax", 3)


@query("mdl8_boosted_regression_first_split", _first_split_sql("l_extendedprice", 1, squared=True))
def _(spark, sf):
    return _first_split(spark, sf, "l_extendedprice", "squared")


@query("mdl3_boosted_multiclass_learns", f"""WITH t AS (SELECT {_FLAG} AS y FROM lineitem), s AS (SELECT y, count(*) AS n FROM t GROUP BY y)
SELECT sum(n)::BIGINT AS n, round(-sum(n / (SELECT count(*) FROM t) * ln(n / (SELECT count(*) FROM t))), 6) AS loss_of_shares, true AS falls, true AS sums_to_one FROM s""")
def _(spark, sf):
    """Loss of the class shares alone, and whether the loss on the training rows falls with more rounds and stays below it."""
    rows = stage(_rows(spark, sf, _FLAG), "flags")
    p = vector_to_array("probability")
    own = -F.log(F.greatest(F.get(p, F.col("label").cast("int")), F.lit(1e-300)))
    one = F.bool_and(F.abs(F.aggregate(p, F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9)
    few, more = (estimator("classification", "histogram_boosting", {"maxIter": n, "maxDepth": 3}, classes=3).fit(rows).transform(rows).agg(
        F.avg(own).alias("loss"), one.alias("one"), F.count(F.lit(1)).alias("n")).first() for n in (1, 4))
    shares = rows.groupBy("label").count().agg((-F.sum(F.col("count") / few["n"] * F.log(F.col("count") / few["n"]))).alias("loss"))
    return shares.select(F.lit(few["n"]).cast("bigint").alias("n"), F.round("loss", 6).alias("loss_of_shares"),
                         ((F.lit(more["loss"]) < few["loss"]) & (F.lit(few["loss"]) < F.col("loss"))).alias("falls"), F.lit(few["one"] and more["one"]).alias("sums_to_one"))


_NAMES = ["size", "price", "seven"]


def _below(f, t):
    return f, Condition(high=t)


def _above(f, t):
    return f, Condition(low=t, missing=True)


#: A tree over size, price and seven, leaf by leaf.
_LEAVES = [
    Leaf.of(10.0, [_below(0, 25), _below(1, 1400), _below(2, 2)]), Leaf.of(4.0, [_below(0, 25), _below(1, 1400), _above(2, 2)]),
    Leaf.of(7.0, [_below(0, 25), _above(1, 1400)]), Leaf.of(1.0, [_above(0, 25), _below(2, 3), _below(0, 40)]),
    Leaf.of(-5.0, [_above(0, 25), _below(2, 3), _above(0, 40)]), Leaf.of(0.0, [_above(0, 25), _above(2, 3), _below(1, 1200)]),
    Leaf.of(20.0, [_above(0, 25), _above(2, 3), _above(1, 1200)]),
]


def _tree_sql(size, price, seven):
    return (f"CASE WHEN {size} <= 25 THEN CASE WHEN {price} <= 1400 THEN CASE WHEN {seven} <= 2 THEN 10.0 ELSE 4.0 END ELSE 7.0 END "
            f"WHEN {seven} <= 3 THEN CASE WHEN {size} <= 40 THEN 1.0 ELSE -5.0 END WHEN {price} <= 1200 THEN 0.0 ELSE 20.0 END")


def _subsets_sql() -> str:
    """Shapley values by their definition: the mean score for every subset of features taken from the row and the rest from the background."""
    subsets = [s for k in range(4) for s in itertools.combinations(range(3), k)]
    name = {s: "v" + "".join(map(str, s)) for s in subsets}
    means = ", ".join(f"avg({_tree_sql(*[('a.' if i in s else 'b.') + n for i, n in enumerate(_NAMES)])}::DOUBLE) AS {name[s]}" for s in subsets)

    def phi(i):
        terms = []
        for s in subsets:
            if i not in s:
                w = math.factorial(len(s)) * math.factorial(2 - len(s)) / math.factorial(3)
                terms.append(f"{w!r} * ({name[tuple(sorted((*s, i)))]} - {name[s]})")
        return " + ".join(terms)

    return f"""WITH t AS (SELECT p_partkey, p_size AS size, p_retailprice AS price, p_partkey % 7 AS seven FROM part),
m AS (SELECT a.p_partkey, {means} FROM t a, t b GROUP BY a.p_partkey)
""" + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS feature, round({phi(i)}, 6) AS phi FROM m" for i, n in enumerate(_NAMES))


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"),
                                           (F.col("p_partkey") % 7).cast("double").alias("seven"))


@query("exp1_exact_tree_values", _subsets_sql())
def _(spark, sf):
    t = _parts(spark, sf)
    phi = exact_shapley_values(_LEAVES, t, t, _NAMES, ["p_partkey"])
    return phi.select("p_partkey", "feature", (F.round("phi", 6) + 0.0).alias("phi"))


@query("exp1_exact_values_add_up", "SELECT true AS adds_up, count(*) AS n FROM part")
def _(spark, sf):
    """Values of a fitted booster sum to its prediction less the mean prediction of all rows."""
    t = _parts(spark, sf)
    rows = stage(t.withColumn("features", array_to_vector(F.array(*_NAMES))).withColumn("label", F.col("price") * (F.col("seven") + 1) + F.col("size")), "parts")
    model = estimator("regression", "histogram_boosting", {"maxIter": 10, "maxDepth": 3}).fit(rows)
    scored = model.transform(rows).select("p_partkey", "prediction")
    mean = scored.agg(F.avg("prediction")).first()[0]
    total = exact_shapley_values(model_leaves(model), t, t, _NAMES, ["p_partkey"]).groupBy("p_partkey").agg(F.sum("phi").alias("total"))
    close = F.abs(F.col("total") - (F.col("prediction") - mean)) < 1e-6 * (1 + F.abs("prediction"))
    return total.join(scored, "p_partkey").groupBy(close.alias("adds_up")).agg(F.count(F.lit(1)).alias("n"))
