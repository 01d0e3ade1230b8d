"""All queries of the core library with their SQL counterparts."""

from __future__ import annotations

from halyard.plans import answer_queries, evidence_queries, graph_queries, memory_queries, outline_queries, path_queries, router_queries, session_queries, symbol_queries

MODULES = (path_queries, symbol_queries, graph_queries, memory_queries, session_queries, outline_queries, router_queries, evidence_queries, answer_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "path_cascade"
