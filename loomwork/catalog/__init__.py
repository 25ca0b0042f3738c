"""Named queries over the test tables, one or more per operator."""

from loomwork.catalog import (choose_queries, classification_queries, cluster_queries,  # noqa: F401
                              prepare_queries, profile_queries, regression_queries,
                              source_queries, model_queries, boosting_queries, mixture_queries, sketch_queries, search_queries,
                              invariant_queries)
from loomwork.catalog.model_queries import flagship
from loomwork.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
