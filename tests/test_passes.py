"""Dear expressions are computed once and columns that nothing reads are not written."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from loomwork.catalog import model_queries as mq
from loomwork.operators import classification_metrics as cm
from loomwork.operators import rank, tune

KEYS = ["k", "part"]


@pytest.fixture
def rows(spark):
    t = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part"), (F.col("id") % 2).cast("double").alias("label"),
                                F.lit(1.0).alias("prediction"), (F.col("id") % 7 / 7.0).alias("score"), F.when(F.col("id") < 100, "valid").otherwise("train").alias("dataset"))
    return VectorAssembler(inputCols=["score", "part"], outputCol="features").transform(t)


def _recorded(monkeypatch, module):
    seen, written = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: seen.append((label, df.columns)) or written(df, label))
    return seen


def test_metric_matrix_writes_rows_once_and_without_keys(rows, monkeypatch):
    ranked, again = _recorded(monkeypatch, rank), _recorded(monkeypatch, cm) if hasattr(cm, "stage") else []
    got = {(r["dataset"], r["metric"]): r["value"] for r in cm.metric_matrix(rows, KEYS, ["dataset"]).collect()}
    assert got["train", "accuracy"] == 0.5 and len(got) == 6
    assert [c for _label, columns in ranked for c in columns if c in KEYS] == [] and again == []


def test_keys_that_are_groups_stay(rows):
    got = rank.with_group_position(rows.select("k", "part"), ["part"], [F.col("k")], drop=KEYS)
    assert set(got.columns) == {"part", "rn", "n"} and got.where("part = 0").agg(F.max("rn"), F.max("n")).first() == (134, 134)


def test_key_hash_is_not_repeated_for_the_encoder(spark, data, monkeypatch, capsys):
    fitted, fit = [], mq.en.fit_encoder
    monkeypatch.setattr(mq.en, "fit_encoder", lambda df, spec: fitted.append(df) or fit(df, spec))
    out, width = mq._binary(spark, data)
    capsys.readouterr()
    fitted[0].explain(True)
    assert "md5" not in capsys.readouterr().out
    assert width == 6 and out.count() == spark.read.parquet(f"{data}/lineitem.parquet").count()


def test_folds_hold_only_what_is_fitted(rows, monkeypatch):
    seen = _recorded(monkeypatch, tune)
    got = tune.cross_validate("classification", "decision_tree", rows, KEYS, folds=2, features=2).first()
    assert got["folds"] == 2 and seen == [("folds", ["label", "features", "fold"])]


def test_balanced_folds_keep_their_keys(rows):
    parts = tune.fold_parts(rows, KEYS, 2, lambda fitted: fitted.where("k >= 0"))
    assert all(set(KEYS) <= set(fitted.columns) for fitted, _judged in parts)
    assert sum(judged.count() for _fitted, judged in parts) == 400
