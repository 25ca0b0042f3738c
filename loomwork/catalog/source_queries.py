"""Source and sink queries: whole tables written to the shared folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwork.catalog.inputs import rounded, scored, table, LINE_KEY, SQL_SCORED
from loomwork.catalog.registry import query
from loomwork.operators import classification_metrics as cm
from loomwork.session import shared_dir
from loomwork.sources import readers, sinks


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}/{name}"


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _typed(df):
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
                     "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


@query("src1_csv", _ORDERS)
def _(spark, sf):
    path = _path(spark, "orders.csv")
    sinks.write_csv(_orders(spark, sf), path)
    return _typed(readers.read_csv(spark, path))


@query("src2_tsv", _ORDERS)
def _(spark, sf):
    path = _path(spark, "orders.tsv")
    _orders(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return _typed(readers.read_tsv(spark, path))


@query("src3_json", _ORDERS)
def _(spark, sf):
    path = _path(spark, "orders.json")
    _orders(spark, sf).write.json(path)
    return _typed(readers.read_json(spark, path))


@query("src4_parquet", "SELECT * FROM customer")
def _(spark, sf):
    return readers.read_parquet(spark, f"{sf}/customer.parquet")


@query("src5_load_dispatch", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS avg_price FROM part GROUP BY p_brand")
def _(spark, sf):
    df, _meta = readers.load(spark, f"{sf}/part.parquet")
    return rounded(df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("avg_price")), 6, "avg_price")


@query("src6_named_dataset", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, sf):
    sinks.stage_view(table(spark, sf, "customer"), "named_customer")
    return readers.load_named(spark, "named_customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_SPEC = readers.ReadSpec(select=["o_orderkey", "o_totalprice / 1000 AS price_k"],
                         where="o_orderstatus = 'F' AND o_totalprice > 100000")
_SPEC_SQL = """SELECT o_orderkey, round(o_totalprice / 1000, 6) AS price_k FROM orders
 WHERE o_orderstatus = 'F' AND o_totalprice > 100000"""


@query("src7_read_spec", _SPEC_SQL)
def _(spark, sf):
    return rounded(_SPEC.apply(table(spark, sf, "orders")), 6, "price_k")


@query("src7_read_spec_sampled")
def _(spark, sf):
    spec = readers.ReadSpec(select=["o_orderstatus"], sample_percent=30.0)
    return spec.apply(table(spark, sf, "orders")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src8_holdout_read", _SPEC_SQL)
def _(spark, sf):
    limited = readers.ReadSpec(_SPEC.select, _SPEC.where, sample_percent=10.0, limit=5)
    return rounded(limited.for_holdout().apply(table(spark, sf, "orders")), 6, "price_k")


@query("src9_preview", """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total_rows, 5 AS total_columns
 FROM customer ORDER BY c_custkey LIMIT 10""")
def _(spark, sf):
    return readers.preview(table(spark, sf, "customer"), ["c_custkey"]).select("c_custkey", "c_name", "total_rows", "total_columns")


@query("snk1_predictions_parquet", f"SELECT label, prediction, count(*) AS n FROM {SQL_SCORED} GROUP BY 1, 2")
def _(spark, sf):
    path = _path(spark, "predictions")
    sinks.write_predictions(scored(spark, sf), path)
    return cm.confusion_counts(spark.read.parquet(path))


@query("snk2_clustered_csv", "SELECT p_partkey, p_size % 4 AS cluster, p_retailprice FROM part")
def _(spark, sf):
    path = _path(spark, "clustered.csv")
    sinks.write_csv(table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("cluster"), "p_retailprice"), path)
    back = readers.read_csv(spark, path)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("cluster").cast("int").alias("cluster"), "p_retailprice")


def _metrics(spark, sf):
    wide = cm.weighted_metrics(scored(spark, sf), groups=["dataset"])
    return rounded(wide.select("dataset", "accuracy"), 6, "accuracy")


_METRICS_SQL = f"""SELECT dataset, round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
 FROM {SQL_SCORED} GROUP BY dataset"""


@query("snk3_metrics_json", _METRICS_SQL)
def _(spark, sf):
    path = _path(spark, "metrics.json")
    sinks.write_table(_metrics(spark, sf), path, "json")
    return spark.read.schema("dataset string, accuracy double").json(path)


@query("snk3_metrics_csv", _METRICS_SQL)
def _(spark, sf):
    path = _path(spark, "metrics.csv")
    sinks.write_table(_metrics(spark, sf), path, "csv")
    return readers.read_csv(spark, path)


@query("snk5_view_and_sql", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    view = sinks.stage_view(table(spark, sf, "nation"), "staged_nation")
    return sinks.query_frame(view, "SELECT n_regionkey, count(*) AS nations FROM {df} GROUP BY n_regionkey")
