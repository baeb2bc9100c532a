"""All queries of the core and their SQL."""

from __future__ import annotations

from graphloom.plans import corpus_core, graph_queries, resolve_queries, stream_queries, tool_queries

MODULES = [corpus_core, graph_queries, resolve_queries, stream_queries, tool_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
