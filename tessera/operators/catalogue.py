"""All queries of the engine's own operators."""

from __future__ import annotations

from tessera.operators import queries_context, queries_ingest, queries_search, queries_store, queries_stream
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_context", "queries_ingest", "queries_search", "queries_store", "queries_stream"]
