"""All queries of the core and their SQL."""

from __future__ import annotations

from lattica.plans import corpus_queries, graph_queries, merge_queries, orphan_queries, quality_queries, text_queries

_MODULES = (orphan_queries, text_queries, graph_queries, corpus_queries, merge_queries, quality_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
