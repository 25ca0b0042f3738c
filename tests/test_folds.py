"""Balancing inside folds: judged rows are neither copied nor mixed into what is fitted."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomwork.operators import tune as tn
from loomwork.operators.smote import smote_vectors
from loomwork.operators.split import oversample


def _rows(spark):
    rare = F.col("id") % 20 == 0
    return spark.range(600).select(F.col("id").alias("key"), rare.cast("double").alias("label"), array_to_vector(F.array(
        F.col("id").cast("double"), F.when(rare, 3.0).otherwise(0.0) + F.col("id") % 7 / 10)).alias("features"))


def test_copies_stay_out_of_judged_rows(spark):
    rows = _rows(spark)
    parts = tn.fold_parts(rows, ["key"], 3, lambda fitted: oversample(fitted, "label", ["key"]))
    assert sum(judged.count() for _, judged in parts) == 600
    for fitted, judged in parts:
        assert fitted.join(judged, "key", "left_semi").count() == 0
        few, many = (fitted.where(F.col("label") == v).count() for v in (1.0, 0.0))
        assert 0.25 * many < few < 0.35 * many and judged.count() == judged.select("key").distinct().count()


def test_mixed_rows_come_from_fitted_rows(spark):
    rows = _rows(spark)
    (fitted, judged), *_ = tn.fold_parts(rows, ["key"], 3, lambda part: smote_vectors(part, "label", "features", ["key"], 2))
    own = rows.join(judged.select("key"), "key", "left_anti").where("label = 1").select(vector_to_array("features")[0].alias("x"))
    low, high = own.agg(F.min("x"), F.max("x")).first()
    rare = fitted.where("label = 1").select(vector_to_array("features")[0].alias("x"))
    assert rare.count() > 3 * own.count() and rare.where((F.col("x") < low) | (F.col("x") > high)).count() == 0
    assert own.exceptAll(rare).count() == 0 and fitted.columns == ["key", "label", "features"]


def test_score_is_that_of_hand_made_folds(spark):
    rows = _rows(spark)
    parts = tn.fold_parts(rows, ["key"], 2)
    a = tn.cross_validate("classification", "logistic", rows, ["key"], folds=2, features=2).first()
    b = tn.cross_validate("classification", "logistic", rows, ["key"], parts=parts, features=2).first()
    assert a == b and a["folds"] == 2
    c = tn.cross_validate("classification", "logistic", rows, ["key"], folds=2, features=2, balance=lambda p: oversample(p, "label", ["key"])).first()
    assert 0.9 < c["mean"] <= 1
