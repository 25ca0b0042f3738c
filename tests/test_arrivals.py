"""Files that arrive are scored once, as a batch would score them."""

from pyspark.sql import functions as F

from loomwork.operators.score import score
from loomwork.plans.classification import ClassificationRun
from loomwork.streaming.arrivals import score_arrivals


def test_every_file_is_scored_once(spark, data, tmp_path):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    train = orders.withColumn("target", F.when(F.col("o_orderstatus") == "F", "final").otherwise("open")).drop("o_orderstatus")
    run = ClassificationRun(models=["logistic"]).fit(train, "target", ["o_orderkey"])
    run.save(str(tmp_path / "run"))
    rows = train.drop("target")
    inbox, args = str(tmp_path / "inbox"), (rows.schema, str(tmp_path / "scored"), str(tmp_path / "seen"))
    rows.where("o_orderkey % 2 = 0").repartition(3).write.parquet(inbox)
    half = rows.where("o_orderkey % 2 = 0").count()
    assert score_arrivals(spark, str(tmp_path / "run"), inbox, *args, files_per_batch=1) == half
    assert score_arrivals(spark, str(tmp_path / "run"), inbox, *args) == 0
    rows.where("o_orderkey % 2 = 1").write.mode("append").parquet(inbox)
    assert score_arrivals(spark, str(tmp_path / "run"), inbox, *args) == rows.count() - half
    cols = ["o_orderkey", "prediction", "positive_probability", "predicted_class"]
    got = spark.read.parquet(str(tmp_path / "scored")).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, score(str(tmp_path / "run"), rows).select(*cols).collect()))
