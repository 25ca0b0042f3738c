"""Factorization machines from summed moments against Spark's solver."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor
from pyspark.sql import functions as F

from loomwork.operators import factorization
from loomwork.operators.models import estimator


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / s for i, s in enumerate((1.0, 500.0, 10.0))]
    df = spark.range(0, 3000, 1, 6).select("id", F.array(*x).alias("x"))
    return df.select("id", array_to_vector("x").alias("features"), (F.col("x")[0] * 7 + F.col("x")[1] * F.col("x")[2] * 90 + F.pmod("id", F.lit(11))).alias("label")).cache()


def _by_id(model, rows):
    return np.array([r[0] for r in model.transform(rows).orderBy("id").select("prediction").collect()])


@pytest.mark.parametrize("params", [{}, {"maxIter": 30, "fitLinear": False}, {"fitIntercept": False, "regParam": 0.01, "factorSize": 3}])
def test_rounds_are_those_of_spark(rows, params):
    mine = estimator("regression", "factorization_machine", params).fit(rows)
    theirs = FMRegressor(factorSize=8, seed=42).setParams(**params).fit(rows)
    assert isinstance(mine, factorization.FittedMachine)
    assert np.allclose(_by_id(mine, rows), _by_id(theirs, rows), rtol=1e-6, atol=1e-6)


def test_rounds_do_not_read_the_rows(spark, rows, monkeypatch):
    """One pass whatever the number of rounds: the cost no longer grows with rounds times rows."""
    passes = []
    summed = factorization.moments
    monkeypatch.setattr(factorization, "moments", lambda df, width: passes.append(1) or summed(df, width))
    for rounds in (5, 100):
        estimator("regression", "factorization_machine", {"maxIter": rounds}).fit(rows)
    assert passes == [1, 1]


def test_saved_and_odd_rows(spark, rows, tmp_path):
    model = estimator("regression", "factorization_machine").fit(rows)
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.array_equal(_by_id(model, rows), _by_id(again, rows))
    with pytest.raises(Exception, match="finite"):
        estimator("regression", "factorization_machine").fit(rows.withColumn("label", F.when(F.col("id") > 5, F.col("label"))))
