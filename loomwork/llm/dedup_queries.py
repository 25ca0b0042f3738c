"""Queries of the duplicate finders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm.chunks import repeated_passages
from loomwork.llm.minhash import near_duplicates
from loomwork.llm.registry import SQL_BLANK_WORD, SQL_LOWER, query, table
from loomwork.llm.suffixes import repeated_spans

def components_sql(source: str) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER}, {SQL_BLANK_WORD}), []) AS ws FROM {source}),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r(v, root) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON v = doc_id"""


@query("op5_minhash_near_dedup", components_sql("documents"))
def minhash_near_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op3_chunk_dedup")
def chunk_dedup(spark, folder):
    return repeated_passages(table(spark, folder, "documents"))


@query("op6_suffix_array_dedup")
def suffix_array_dedup(spark, folder):
    return repeated_spans(table(spark, folder, "documents"))
