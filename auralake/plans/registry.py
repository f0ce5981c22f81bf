"""Queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from auralake.plans import array_queries, catalog_queries, governance_queries, ordered_queries, reference_queries, signal_queries, source_queries, stats_queries, stream_queries, table_queries
from auralake.plans.base import ORACLE_SQL, QUERIES

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]

#: Importing a module registers its queries.
MODULES = (catalog_queries, stats_queries, table_queries, ordered_queries, array_queries, stream_queries, signal_queries, governance_queries, source_queries, reference_queries)
