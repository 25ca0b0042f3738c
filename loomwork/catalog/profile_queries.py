"""Projection, filtering, profiling, data-quality and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.catalog.inputs import LINE_KEY, SQL_KEY, rounded, table
from loomwork.catalog.registry import query
from loomwork.functions.columns import hash_code, looks_like_date, text_to_number
from loomwork.operators import profile as pf
from loomwork.operators import split as sp
from loomwork.operators.encode import impute_numeric
from loomwork.operators.regression_metrics import drop_incomplete, incomplete_counts, with_residuals

_BUCKET = "('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def sql_bucket(key: str, seed: int = 42) -> str:
    return _BUCKET.format(key=key, seed=seed)


@query("prj1_seeded_sample")
def _(spark, sf):
    return table(spark, sf, "orders").sample(False, 0.2, 42).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("prj1_key_hash_sample", f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE {sql_bucket('o_orderkey::VARCHAR')} < 0.2 GROUP BY 1")
def _(spark, sf):
    tagged = sp.assign_split(table(spark, sf, "orders"), ["o_orderkey"], {"in": 0.2, "out": 0.8})
    return tagged.where("dataset = 'in'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("prj2_feature_name_rules", "SELECT l_orderkey, l_partkey, l_suppkey, l_discount FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    names = pf.feature_names(df.columns, "l_returnflag", include_prefix=["l_"], include_suffix=["key", "t"],
                             exclude=["l_tax"], exclude_prefix=["l_line"], exclude_suffix=["status"])
    return df.select(*names)


def _dated(spark, sf):
    return table(spark, sf, "lineitem").withColumns({
        "ship_date_txt": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "time_code": F.col("l_returnflag"),
        "unix_time": F.lit(1600000000) + F.col("l_orderkey"),
    })


@query("prj4_date_like_columns", r"""
SELECT 'l_shipdate' AS "column", 'type' AS reason WHERE (SELECT any_value(typeof(l_shipdate)) FROM lineitem) LIKE 'TIMESTAMP%'
UNION ALL SELECT 'ship_date_txt', 'pattern'
 WHERE (SELECT avg(regexp_matches(strftime(l_shipdate, '%Y-%m-%d'), '\d{4}-\d{2}-\d{2}')::INTEGER) FROM lineitem) > 0.5
UNION ALL SELECT 'time_code', 'pattern' WHERE (SELECT avg(regexp_matches(l_returnflag, '\d{4}-\d{2}-\d{2}|^\d{10,13}$')::INTEGER) FROM lineitem) > 0.5
UNION ALL SELECT 'unix_time', 'pattern'
 WHERE (SELECT avg(regexp_matches((1600000000 + l_orderkey)::VARCHAR, '^\d{10,13}$')::INTEGER) FROM lineitem) > 0.5""")
def _(spark, sf):
    return pf.date_like_columns(_dated(spark, sf))


_GAPS = """(SELECT nullif(l_tax, 0) AS tax, nullif(l_discount, 0) AS discount, l_quantity,
 CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END AS flag,
 CASE WHEN l_linenumber < 7 THEN NULL ELSE l_linestatus END AS status FROM lineitem)"""


def _gaps(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), "l_quantity",
        F.when(n == 1, "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(n >= 7, F.col("l_linestatus")).alias("status"))


def _sql_missing(extra: str = "") -> str:
    parts = []
    for c in ["tax", "discount", "l_quantity", "flag", "status"]:
        blank = f"{c} IS NULL" + (f" OR {c} = ''" if c in ("flag", "status") else "")
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER ({blank}) AS missing, count(*) AS rows FROM {_GAPS}")
    return f"SELECT *, round(missing::DOUBLE / rows, 6) AS ratio FROM ({' UNION ALL '.join(parts)}) {extra}"


@query("prj5_columns_below_missing", _sql_missing("WHERE missing::DOUBLE / rows <= 0.7"))
def _(spark, sf):
    return rounded(pf.columns_below_missing(_gaps(spark, sf), 0.7), 6, "ratio")


@query("agg1_missing_counts", _sql_missing())
def _(spark, sf):
    return rounded(pf.missing_counts(_gaps(spark, sf)), 6, "ratio")


_DIRTY = """(SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '?' WHEN 2 THEN '' WHEN 3 THEN NULL
 WHEN 4 THEN '$' || c_custkey || '.5' WHEN 5 THEN 'unknown' ELSE (c_custkey * 10)::VARCHAR END AS txt FROM customer)"""


def _dirty(spark, sf):
    k = F.col("c_custkey")
    m = k % 7
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(m == 0, "NA").when(m == 1, "?").when(m == 2, "").when(m == 3, F.lit(None).cast("string"))
        .when(m == 4, F.concat(F.lit("$"), k.cast("string"), F.lit(".5"))).when(m == 5, "unknown")
        .otherwise((k * 10).cast("string")).alias("txt"))


@query("prj6_clean_text_target", f"""SELECT c_custkey, try_cast(txt AS DOUBLE) AS txt FROM {_DIRTY}
 WHERE try_cast(txt AS DOUBLE) IS NOT NULL""")
def _(spark, sf):
    return pf.clean_target(_dirty(spark, sf), "txt")


@query("prj6_indexed_target", """
WITH r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders GROUP BY 1)
SELECT i::DOUBLE AS o_orderpriority, count(*) AS n FROM orders JOIN r USING (o_orderpriority) GROUP BY 1""")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderpriority")
    return pf.numeric_or_indexed_target(t, "o_orderpriority").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("prj7_incomplete_counts", """SELECT count(*) AS rows, count(*) FILTER (l_tax = 0) AS null_actual,
 count(*) FILTER (l_discount = 0) AS null_prediction, count(*) FILTER (l_tax <> 0 AND l_discount <> 0) AS valid_rows FROM lineitem""")
def _(spark, sf):
    return incomplete_counts(_gaps(spark, sf), "tax", "discount")


@query("prj7_complete_rows", "SELECT l_tax AS tax, l_discount AS discount FROM lineitem WHERE l_tax <> 0 AND l_discount <> 0")
def _(spark, sf):
    return drop_incomplete(_gaps(spark, sf).select("tax", "discount"), "tax", "discount")


@query("prj8_table_summary", """SELECT position::INTEGER AS position, c AS "column", d AS dtype, (SELECT count(*) FROM customer) AS rows, 5 AS columns
 FROM (VALUES (1, 'c_custkey', 'bigint'), (2, 'c_name', 'string'), (3, 'c_nationkey', 'int'), (4, 'c_mktsegment', 'string'),
 (5, 'c_acctbal', 'double')) v(position, c, d)""")
def _(spark, sf):
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
    return pf.table_summary(table(spark, sf, "customer").select(*cols))


@query("prj9_size_class", """SELECT name, n AS rows, CASE WHEN n < 10000 THEN 'small' WHEN n < 100000 THEN 'medium' ELSE 'large' END AS size_class,
 CASE WHEN n < 10000 THEN 1.0::DOUBLE WHEN n < 100000 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS sampling_fraction FROM (
 SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer)""")
def _(spark, sf):
    parts = [pf.size_report(table(spark, sf, t)).withColumn("name", F.lit(t)) for t in ("lineitem", "customer")]
    return parts[0].unionByName(parts[1])


_WIDTH = """
SELECT "column", w AS width, n AS rows, round(w * n / 1048576.0::DOUBLE, 6) AS est_mb FROM (
 SELECT 'o_orderkey' AS "column", 8.0::DOUBLE AS w, count(*) AS n FROM orders
 UNION ALL SELECT 'o_custkey', 8.0::DOUBLE, count(*) FROM orders
 UNION ALL SELECT 'o_totalprice', 8.0::DOUBLE, count(*) FROM orders
 UNION ALL SELECT 'o_orderdate', 16.0::DOUBLE, count(*) FROM orders
 UNION ALL SELECT 'o_orderstatus', round((avg(length(o_orderstatus)) + max(length(o_orderstatus))) / 2, 6), count(*) FROM orders
 UNION ALL SELECT 'o_orderpriority', round((avg(length(o_orderpriority)) + max(length(o_orderpriority))) / 2, 6), count(*) FROM orders)"""


@query("prj10_width_profile", _WIDTH)
def _(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"]
    return rounded(rounded(pf.width_profile(table(spark, sf, "orders").select(*cols)), 6, "width"), 6, "est_mb")


@query("prj10_size_category", f"""SELECT round(sum(width * rows / 1048576.0::DOUBLE), 4) AS est_mb,
 CASE WHEN sum(est_mb) < 100 THEN 'small' WHEN sum(est_mb) < 1000 THEN 'medium' WHEN sum(est_mb) < 10000 THEN 'large' ELSE 'huge' END AS category
 FROM ({_WIDTH})""")
def _(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"]
    return rounded(pf.size_category(pf.width_profile(table(spark, sf, "orders").select(*cols))), 4, "est_mb")


@query("prj11_complexity", """SELECT 2 AS text_columns, h AS high_cardinality_columns, 4 AS types,
 least(1.0::DOUBLE, round(0.2::DOUBLE + 0.2::DOUBLE * h + 0.4::DOUBLE, 6)) AS score FROM (
 SELECT ((count(DISTINCT c_name) > 1000)::INTEGER + (count(DISTINCT c_mktsegment) > 1000)::INTEGER) AS h FROM customer)""")
def _(spark, sf):
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
    return rounded(pf.complexity_score(table(spark, sf, "customer").select(*cols)), 6, "score")


@query("prj12_task_kind", """SELECT 'orders' AS name, count(DISTINCT o_orderpriority) AS classes, 'multiclass' AS kind, 'accuracy' AS criterion FROM orders
 UNION ALL SELECT 'lineitem', count(DISTINCT l_linestatus), 'binary', 'ks' FROM lineitem""")
def _(spark, sf):
    a = pf.task_kind(table(spark, sf, "orders"), "o_orderpriority").withColumn("name", F.lit("orders"))
    b = pf.task_kind(table(spark, sf, "lineitem"), "l_linestatus").withColumn("name", F.lit("lineitem"))
    return a.unionByName(b)


@query("prj13_suggest_target", """
SELECT 'classification' AS task, CASE WHEN (SELECT count(DISTINCT l_linestatus) FROM lineitem) = 2 THEN 'l_linestatus' ELSE 'l_returnflag' END AS "column"
UNION ALL SELECT 'regression', 'l_quantity'""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    parts = [pf.suggest_target(df, t).withColumn("task", F.lit(t)) for t in ("classification", "regression")]
    return parts[0].unionByName(parts[1])


_TEXT = ["l_returnflag", "l_linestatus"]


@query("agg2_distinct_counts", """SELECT 'c_name' AS "column", count(DISTINCT c_name) AS "distinct" FROM customer
 UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer""")
def _(spark, sf):
    return pf.distinct_counts(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query("agg2_approx_distinct_counts")
def _(spark, sf):
    return pf.distinct_counts(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], approximate=True)


@query("agg3_cardinality_roles", """SELECT "column", d AS "distinct", CASE WHEN d > 50 THEN 'numeric' ELSE 'categorical' END AS role, d <= 200 AS encodable FROM (
 SELECT 'p_name' AS "column", count(DISTINCT p_name) AS d FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
 UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)""")
def _(spark, sf):
    return pf.cardinality_roles(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("agg4_class_distribution", """
WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1)
SELECT class, n AS "count", round(n::DOUBLE / sum(n) OVER (), 6) AS share,
 CASE WHEN row_number() OVER (ORDER BY n, class) = 1 THEN 'minority' WHEN row_number() OVER (ORDER BY n DESC, class DESC) = 1 THEN 'majority'
 ELSE 'other' END AS role, count(*) OVER () AS classes FROM c""")
def _(spark, sf):
    return rounded(pf.class_distribution(table(spark, sf, "orders"), "o_orderstatus"), 6, "share")


_RARE = "(SELECT doc_id, n_chars, CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS rare FROM labels JOIN documents USING (doc_id))"


def rare_class(spark, sf):
    """labels joined to documents with a class of a few percent."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "n_chars", "quality", "toxic",
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1).otherwise(0).alias("rare"))


@query("agg5_imbalance", f"""
SELECT round(min(s), 6) AS smallest_share, count(*) FILTER (s < 0.05) AS classes_below, min(s) < 0.05 AS imbalanced
FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM {_RARE} GROUP BY rare)""")
def _(spark, sf):
    return rounded(pf.imbalance(rare_class(spark, sf), "rare"), 6, "smallest_share")


@query("fun1_text_to_number", f"""SELECT c_custkey, CASE WHEN txt IS NULL OR trim(txt) IN ('', '?', 'NA', 'NULL') THEN NULL
 ELSE try_cast(regexp_replace(txt, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS number FROM {_DIRTY}""")
def _(spark, sf):
    return _dirty(spark, sf).select("c_custkey", text_to_number(F.col("txt")).alias("number"))


@query("fun2_hash_codes")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hash_code(F.col("c_name")).alias("code"))


@query("fun3_impute", f"SELECT {SQL_KEY}, CASE WHEN l_tax = 0 THEN -999.0::DOUBLE ELSE l_tax END AS tax FROM lineitem")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select(*LINE_KEY, F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return impute_numeric(t, ["tax"], -999.0)


@query("fun5_residual_columns", f"""SELECT {SQL_KEY}, l_extendedprice AS actual, l_quantity * 1500.0::DOUBLE AS prediction,
 round(l_quantity * 1500.0::DOUBLE - l_extendedprice, 4) AS residual, round(abs(l_quantity * 1500.0::DOUBLE - l_extendedprice), 4) AS absolute_error FROM lineitem""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select(*LINE_KEY, F.col("l_extendedprice").alias("actual"),
                                            (F.col("l_quantity") * 1500.0).alias("prediction"))
    return rounded(with_residuals(t), 4, "residual", "absolute_error")


@query("fun7_date_like_text", r"""
SELECT event_id, regexp_matches(t, '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4}|^\d{10,13}$') AS date_like
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 2 THEN event_type
  WHEN 3 THEN (1600000000 + event_id)::VARCHAR ELSE user_id::VARCHAR END AS t FROM events)""")
def _(spark, sf):
    m = F.col("event_id") % 5
    text = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd")).when(m == 1, F.date_format("ts", "dd/MM/yyyy"))
            .when(m == 2, F.col("event_type")).when(m == 3, (F.lit(1600000000) + F.col("event_id")).cast("string"))
            .otherwise(F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", looks_like_date(text).alias("date_like"))
