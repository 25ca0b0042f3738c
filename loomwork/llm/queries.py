"""All queries of this subpackage."""

from loomwork.llm import alignment_queries, classifier_queries, decontaminate_queries, dedup_queries, periods_queries, personal_queries, quality_queries, sampling_queries, warc_queries  # noqa: F401
from loomwork.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
