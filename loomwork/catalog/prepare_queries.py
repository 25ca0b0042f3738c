"""Encoding, splitting, balancing, feature-ranking, sort, set and join queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomwork.catalog.inputs import LINE_KEY, SQL_KEY, rounded, table
from loomwork.catalog.profile_queries import _RARE, rare_class, sql_bucket
from loomwork.catalog.registry import query
from loomwork.operators import encode as en
from loomwork.operators import features as fs
from loomwork.operators import split as sp
from loomwork.session import with_row

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _sql_index(column: str, source: str) -> str:
    return f"SELECT {column}, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS i FROM {source} GROUP BY 1"


@query("enc1_index_categories", f"""
WITH a AS ({_sql_index('o_orderstatus', 'orders')}), b AS ({_sql_index('o_orderpriority', 'orders')})
SELECT o_orderkey, a.i::DOUBLE AS o_orderstatus_encoded, b.i::DOUBLE AS o_orderpriority_encoded
FROM orders JOIN a USING (o_orderstatus) JOIN b USING (o_orderpriority)""")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cols = ["o_orderstatus", "o_orderpriority"]
    return en.index_categories(t, cols).transform(t).drop(*cols)


@query("enc1_unseen_category", f"""
WITH a AS ({_sql_index('o_orderpriority', "(FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH')")})
SELECT o_orderkey, coalesce(i, (SELECT count(*) FROM a))::DOUBLE AS o_orderpriority_encoded FROM orders LEFT JOIN a USING (o_orderpriority)""")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    seen = t.where("o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'")
    return en.index_categories(seen, ["o_orderpriority"]).transform(t).select("o_orderkey", "o_orderpriority_encoded")


@query("enc1_index_dictionary", f"""WITH a AS ({_sql_index('c_name', 'customer')})
SELECT 'c_name' AS "column", c_name::VARCHAR AS value, i::DOUBLE AS index FROM a
UNION ALL SELECT 'l_partkey', value, (row_number() OVER (ORDER BY n DESC, value) - 1)::DOUBLE
 FROM (SELECT l_partkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    parts = [en.index_dictionary(table(spark, sf, t), c).select(F.lit(c).alias("column"), "value", "index") for t, c in (("customer", "c_name"), ("lineitem", "l_partkey"))]
    return parts[0].unionByName(parts[1])


@query("enc2_index_target_by_dictionary", f"""WITH a AS ({_sql_index('o_orderpriority', "(FROM orders WHERE o_orderpriority <> '2-HIGH')")})
SELECT coalesce(i, -1)::DOUBLE AS label, count(*) AS n FROM orders LEFT JOIN a USING (o_orderpriority) GROUP BY 1""")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderpriority")
    known = en.index_dictionary(t.where("o_orderpriority <> '2-HIGH'"), "o_orderpriority")
    return en.index_by_dictionary(t, "o_orderpriority", known, "label", -1.0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("enc2_index_target", f"""WITH a AS ({_sql_index('o_orderstatus', 'orders')})
SELECT i::DOUBLE AS label, count(*) AS n FROM orders JOIN a USING (o_orderstatus) GROUP BY 1""")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderstatus")
    return en.index_target(t, "o_orderstatus").transform(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("enc3_apply_to_new_data", f"""
WITH old AS (SELECT * FROM orders WHERE year(o_orderdate) <= 1999), a AS ({_sql_index('o_orderpriority', 'old')}),
s AS (SELECT stddev_samp(i::DOUBLE) AS sp, stddev_samp(o_totalprice) AS st FROM old JOIN a USING (o_orderpriority))
SELECT o_orderkey, round(coalesce(i, (SELECT count(*) FROM a)) / sp, 6) AS f0, round(o_totalprice / st, 6) AS f1
FROM orders LEFT JOIN a USING (o_orderpriority), s WHERE year(o_orderdate) > 1999""")
def _(spark, sf):
    t = table(spark, sf, "orders")
    spec = en.FeatureSpec(None, categorical=["o_orderpriority"], numeric=["o_totalprice"])
    old, new = t.where(F.year("o_orderdate") <= 1999), t.where(F.year("o_orderdate") > 1999)
    model = en.fit_encoder(en.prepare_columns(old, spec), spec)
    v = vector_to_array("features")
    out = model.transform(en.prepare_columns(new, spec)).select("o_orderkey", v[0].alias("f0"), v[1].alias("f1"))
    return rounded(out, 6, "f0", "f1")


@query("enc4_assemble", f"SELECT {SQL_KEY}, l_quantity AS f0, l_tax AS f1 FROM lineitem")
def _(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    t = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_tax")
    v = vector_to_array("features")
    out = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features", handleInvalid="skip").transform(t)
    return out.select(*LINE_KEY, v[0].alias("f0"), v[1].alias("f1"))


@query("enc5_standardise", f"""
WITH s AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_tax) AS t FROM lineitem WHERE year(l_shipdate) <= 1999)
SELECT {SQL_KEY}, CASE WHEN year(l_shipdate) <= 1999 THEN 'train' ELSE 'oot' END AS dataset, round(l_quantity / q, 6) AS f0,
 round(l_tax / t, 6) AS f1 FROM lineitem, s""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_tax", F.year("l_shipdate").alias("y"))
    frames = en.standardised(t.where("y <= 1999"), {"oot": t.where("y > 1999")}, ["l_quantity", "l_tax"])
    v = vector_to_array("features")
    tagged = [f.select(*LINE_KEY, F.lit(n).alias("dataset"), v[0].alias("f0"), v[1].alias("f1")) for n, f in frames.items()]
    return rounded(sp.union_frames(tagged), 6, "f0", "f1")


@query("enc6_clustering_frame", f"""
WITH a AS ({_sql_index('p_brand', 'part')}), s AS (SELECT stddev_samp(i::DOUBLE) AS b, stddev_samp(p_size) AS z, stddev_samp(p_retailprice) AS r
 FROM part JOIN a USING (p_brand))
SELECT p_partkey, round(i / b, 6) AS f0, round(p_size / z, 6) AS f1, round(p_retailprice / r, 6) AS f2 FROM part JOIN a USING (p_brand), s""")
def _(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", F.col("p_partkey").alias("row_id"))
    spec = en.clustering_spec(t.drop("p_partkey"))
    ready = en.prepare_columns(t, spec)
    v = vector_to_array("features")
    out = en.fit_encoder(ready, spec).transform(ready)
    return rounded(out.select("p_partkey", *[v[i].alias(f"f{i}") for i in range(3)]), 6, "f0", "f1", "f2")


@query("enc7_holdout_columns", """SELECT * FROM (VALUES ('oot1', true, ''), ('oot2', false, 'o_totalprice')) v(dataset, usable, missing)
 WHERE (SELECT count(*) FROM orders) > 0""")
def _(spark, sf):
    t = table(spark, sf, "orders")
    return en.holdout_report({"oot1": t, "oot2": t.drop("o_totalprice")}, ["o_orderstatus", "o_totalprice"], spark)


_SHARES = {"train": 0.4, "valid": 0.3, "test": 0.3}


@query("spl1_random_split")
def _(spark, sf):
    parts = sp.random_split(table(spark, sf, "orders").select("o_orderkey"), _SHARES)
    return sp.union_frames([df.agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(n)) for n, df in parts.items()])


@query("spl1_random_split_covers", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def _(spark, sf):
    parts = sp.random_split(table(spark, sf, "orders").select("o_orderkey"), _SHARES)
    return sp.union_frames(list(parts.values())).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))


_B = sql_bucket("o_orderkey::VARCHAR")


@query("set2_balanced_folds", f"""
WITH t AS (SELECT *, floor({sql_bucket('doc_id::VARCHAR')} * 3)::INTEGER AS home FROM {_RARE}),
d AS (SELECT fold::INTEGER AS fold, t.* FROM t, range(3) f(fold) WHERE home <> fold), c AS (SELECT fold, rare, count(*) AS n FROM d GROUP BY 1, 2),
w AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY fold) AS s, floor(max(n) OVER (PARTITION BY fold) * 0.3::DOUBLE)::BIGINT AS wanted FROM c),
r AS (SELECT fold, rare, CASE WHEN s < 0.3 AND n < wanted THEN (wanted - n)::DOUBLE / n ELSE 0 END AS rate FROM w),
x AS (SELECT fold, rare, count(*) AS documents, sum(1 + floor(rate) + CASE WHEN {sql_bucket('doc_id::VARCHAR', 12345)} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT
      AS fitted FROM d JOIN r USING (fold, rare) GROUP BY 1, 2)
SELECT fold, rare, fitted, documents, (SELECT count(*) FROM t WHERE home = x.fold AND t.rare = x.rare) AS judged, 0::BIGINT AS shared FROM x""")
def _(spark, sf):
    """Copies are made of a fold's own rows to fit; what is judged is neither copied nor fitted."""
    from loomwork.operators.tune import fold_parts
    parts = fold_parts(rare_class(spark, sf), ["doc_id"], 3, lambda fitted: sp.oversample(fitted, "rare", ["doc_id"]))
    out = []
    for f, (fitted, judged) in enumerate(parts):
        both = fitted.select("rare", "doc_id", F.lit(0).alias("held")).unionByName(judged.select("rare", "doc_id", F.lit(1).alias("held")))
        each = both.groupBy("rare", "doc_id").agg(F.sum(1 - F.col("held")).alias("fitted"), F.sum("held").alias("judged"))
        out.append(each.groupBy("rare").agg(
            F.sum("fitted").alias("fitted"), F.count_if(F.col("fitted") > 0).alias("documents"), F.sum("judged").alias("judged"),
            F.count_if((F.col("fitted") > 0) & (F.col("judged") > 0)).alias("shared")).withColumn("fold", F.lit(f)))
    return sp.union_frames(out)


@query("spl2_key_hash_split", f"""SELECT o_orderkey, CASE WHEN b < 0.4 THEN 'train' WHEN b < 0.7 THEN 'valid' ELSE 'test' END AS dataset
 FROM (SELECT o_orderkey, {_B} AS b FROM orders)""")
def _(spark, sf):
    return sp.assign_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], _SHARES)


@query("spl3_folds", f"SELECT floor({_B} * 5)::INTEGER AS fold, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return sp.assign_fold(table(spark, sf, "orders"), ["o_orderkey"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("spl4_cv_or_split", """SELECT m AS mode, h AS has_holdout, n AS rows, CASE m WHEN 'always' THEN true WHEN 'never' THEN false
 ELSE NOT h OR n < 5000 END AS cross_validate FROM (VALUES ('always', true), ('never', false), ('auto', true), ('auto', false)) v(m, h),
 (SELECT count(*) AS n FROM orders)""")
def _(spark, sf):
    t = table(spark, sf, "orders")
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(m).alias("mode"), F.lit(h).alias("has_holdout"), "rows",
        sp.use_cross_validation(F.col("rows"), m, h).alias("cross_validate"))
        for m, h in [("always", True), ("never", False), ("auto", True), ("auto", False)]]
    return sp.union_frames(parts)


@query("bal1_oversample_plan", f"""
WITH c AS (SELECT rare::VARCHAR AS class, count(*) AS n FROM {_RARE} GROUP BY 1),
w AS (SELECT *, n::DOUBLE / sum(n) OVER () AS s, floor(max(n) OVER () * 0.3::DOUBLE)::BIGINT AS wanted FROM c)
SELECT class, n AS "count", wanted, CASE WHEN s < 0.3 AND n < wanted THEN wanted - n ELSE 0 END AS extra FROM w""")
def _(spark, sf):
    return sp.oversample_plan(rare_class(spark, sf), "rare")


@query("bal1_oversample", f"""
WITH c AS (SELECT rare, count(*) AS n FROM {_RARE} GROUP BY 1),
w AS (SELECT *, n::DOUBLE / sum(n) OVER () AS s, floor(max(n) OVER () * 0.3::DOUBLE)::BIGINT AS wanted FROM c),
r AS (SELECT rare, CASE WHEN s < 0.3 AND n < wanted THEN (wanted - n)::DOUBLE / n ELSE 0 END AS rate FROM w),
x AS (SELECT d.*, (floor(rate) + CASE WHEN {sql_bucket('doc_id::VARCHAR', 12345)} < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS extra
      FROM {_RARE} d JOIN r USING (rare))
SELECT doc_id, rare, n_chars, unnest(range(extra + 1))::BIGINT AS copy FROM x""")
def _(spark, sf):
    out = sp.oversample(rare_class(spark, sf), "rare", ["doc_id"], copy="copy")
    return out.select("doc_id", "rare", "n_chars", "copy")


@query("bal3_balance_switch", f"""
WITH c AS (SELECT rare::VARCHAR AS class, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM {_RARE} GROUP BY 1)
SELECT min(s) < 0.05 AS imbalanced, min(s) < 0.05 AS balance FROM c""")
def _(spark, sf):
    from loomwork.operators.profile import imbalance
    return imbalance(rare_class(spark, sf), "rare").select("imbalanced", F.col("imbalanced").alias("balance"))


_SQL_VAR = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}::DOUBLE) AS variance FROM lineitem" for c in NUMERIC)
_SQL_COR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}::DOUBLE, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END)) AS correlation FROM lineitem"
    for c in NUMERIC)


def _labelled(spark, sf):
    return table(spark, sf, "lineitem").withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


@query("agg6_feature_variances", f"SELECT feature, round(variance, 4) AS variance FROM ({_SQL_VAR}) WHERE variance > 1e-6")
def _(spark, sf):
    return rounded(fs.feature_variances(_labelled(spark, sf), NUMERIC).where("variance > 1e-6"), 4, "variance")


@query("agg7_target_correlations", f"SELECT feature, round(correlation, 6) AS correlation FROM ({_SQL_COR})")
def _(spark, sf):
    return rounded(fs.target_correlations(_labelled(spark, sf), NUMERIC, "label"), 6, "correlation")


_SQL_IMP = f"""SELECT feature, variance / sum(variance) OVER () AS importance, row_number() OVER (ORDER BY variance DESC, feature) AS rank FROM ({_SQL_VAR})"""


@query("agg8_variance_importance", f"SELECT feature, round(importance, 9) AS importance, rank::INTEGER AS rank FROM ({_SQL_IMP})")
def _(spark, sf):
    return rounded(fs.variance_importance(_labelled(spark, sf), NUMERIC), 9, "importance")


@query("fsl4_statistical_filter", f"""
SELECT feature, round(variance, 4) AS variance, round(correlation, 6) AS correlation FROM ({_SQL_VAR}) JOIN ({_SQL_COR}) USING (feature)
WHERE variance > 1e-3 ORDER BY correlation DESC, feature LIMIT 3""")
def _(spark, sf):
    out = fs.statistical_filter(_labelled(spark, sf), NUMERIC, "label", 3, 1e-3)
    return rounded(rounded(out, 4, "variance"), 6, "correlation")


@query("srt1_balanced_order", f"""
SELECT doc_id, rare, row_number() OVER (ORDER BY rare DESC, doc_id) AS position FROM {_RARE}""")
def _(spark, sf):
    from loomwork.operators.rank import with_position
    slim = rare_class(spark, sf).select("doc_id", "rare")
    return with_position(slim, [F.col("rare").desc(), F.col("doc_id")], "position")


@query("srt2_top_features", f"SELECT feature, round(importance, 9) AS importance, rank::INTEGER AS rank FROM ({_SQL_IMP}) WHERE importance >= 0.01 AND rank <= 3")
def _(spark, sf):
    out = fs.top_by_importance(fs.variance_importance(_labelled(spark, sf), NUMERIC).drop("rank"), 3)
    return rounded(out, 9, "importance")


@query("srt2_top_features_fallback", f"SELECT feature, round(importance, 9) AS importance, rank::INTEGER AS rank FROM ({_SQL_IMP}) WHERE rank <= 4")
def _(spark, sf):
    out = fs.top_by_importance(fs.variance_importance(_labelled(spark, sf), NUMERIC).drop("rank"), 4, threshold=2.0)
    return rounded(out, 9, "importance")


@query("srt3_report_top", f"SELECT feature, round(importance, 9) AS importance, rank::INTEGER AS rank FROM ({_SQL_IMP}) ORDER BY rank LIMIT 10")
def _(spark, sf):
    return rounded(fs.report_top(fs.variance_importance(_labelled(spark, sf), NUMERIC)), 9, "importance")


@query("srt4_row_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return t.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("set1_union_oversampled", f"SELECT rare, count(*) AS n FROM (SELECT rare FROM {_RARE} UNION ALL SELECT rare FROM {_RARE} WHERE rare = 1) GROUP BY 1")
def _(spark, sf):
    t = rare_class(spark, sf)
    return sp.union_frames([t, t.where("rare = 1")]).groupBy("rare").agg(F.count(F.lit(1)).alias("n"))


@query("set2_union_splits", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, round(sum(o_totalprice), 2) AS total FROM orders")
def _(spark, sf):
    parts = sp.split_frames(table(spark, sf, "orders"), ["o_orderkey"], _SHARES)
    both = sp.union_frames(list(parts.values())).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_totalprice").alias("total"))
    return rounded(both, 2, "total")


@query("joi1_features_and_target", f"SELECT {SQL_KEY}, l_quantity, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem")
def _(spark, sf):
    return _labelled(spark, sf).select(*LINE_KEY, "l_quantity", "l_tax", "label")


@query("joi1_join_on_key", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", "n_chars")
    return x.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("fsl1_forest_selection")
def _(spark, sf):
    imp = fs.forest_importances(_labelled(spark, sf), NUMERIC, "label")
    return rounded(fs.top_by_importance(imp, 30), 6, "importance")


@query("fsl2_adaptive_forest")
def _(spark, sf):
    return rounded(fs.forest_importances(_labelled(spark, sf), NUMERIC, "label", adaptive=True), 6, "importance")


@query("fsl3_sequential_selection")
def _(spark, sf):
    names = fs.sequential_selection(_labelled(spark, sf), NUMERIC, "label", 2, chunk=3, keep=2)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("fsl5_selection_sample", "SELECT least(count(*), 20000) AS n, count(*) AS all_rows FROM lineitem")
def _(spark, sf):
    t = table(spark, sf, "lineitem")
    whole = fs.fit_sample(t, None).agg(F.count(F.lit(1)).alias("all_rows"))
    return with_row(fs.fit_sample(t, 20_000).agg(F.count(F.lit(1)).alias("n")), whole)


@query("fsl6_regression_importances")
def _(spark, sf):
    feats = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return rounded(fs.forest_importances(_labelled(spark, sf), feats, "l_extendedprice", "regression"), 6, "importance")
