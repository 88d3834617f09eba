"""All queries of the library."""

from ohmgraph.plans import catalog, model_queries, source_queries
from ohmgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "model_queries", "source_queries"]
