"""Query of the personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm.personal import BASE_KINDS, personal_data
from loomwork.llm.registry import query, table


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(*kinds):
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


@query("op12_personal_data")
def personal_data_spans(spark, folder):
    found = personal_data(table(spark, folder, "documents"), columns=["doc_id"])
    base = _of_kind(*BASE_KINDS)
    counts = [F.size(_of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
