"""All queries of the library."""

from . import extra_queries, evaluation_queries, function_queries, graph_queries, intent_queries, ranking_queries, search_queries, source_queries, table_queries, understanding_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
