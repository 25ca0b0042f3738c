"""Queries of the text classifiers."""

from __future__ import annotations

from loomwork.llm.line_crf import fit_line_quality, held_out_column, line_quality
from loomwork.llm.registry import query, table
from loomwork.llm.toxicity import fit_toxicity, toxicity


@query("op10_line_quality")
def line_quality_scores(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = line_quality(docs, fit_line_quality(docs, labels), columns=["doc_id"])
    return scored.select("doc_id", held_out_column(), "score", "predicted")


@query("op2_toxicity")
def toxicity_scores(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity(docs, fit_toxicity(docs, labels), columns=["doc_id"])
    return scored.select("doc_id", held_out_column(), "expected_severity", "p_toxic", "grade", "toxic")
