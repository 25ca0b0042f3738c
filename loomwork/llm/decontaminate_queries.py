"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm.decontaminate import contamination
from loomwork.llm.registry import SQL_LOWER, SQL_PLAIN_WORD, query, table

def contamination_sql(source: str) -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER}, {SQL_PLAIN_WORD}), []) AS ws FROM {source}),
b AS (SELECT item_id, regexp_extract_all({SQL_LOWER}, {SQL_PLAIN_WORD}) AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS s
      FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS p FROM b WHERE len(ws) > 0)),
w AS (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS s
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT doc_id, item_id, p, n FROM w JOIN i USING (n, s)),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op9_benchmark_decontamination", contamination_sql("documents"))
def benchmark_decontamination(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
