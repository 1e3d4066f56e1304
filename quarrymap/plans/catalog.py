"""All queries by name, with SQL for those that it can express."""

from __future__ import annotations

from quarrymap.plans import (  # noqa: F401
    context_queries, graph_queries, lookup_queries, map_queries, publish_queries, rename_queries, retrieval_queries, source_queries, temporal_queries,
)
from quarrymap.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
