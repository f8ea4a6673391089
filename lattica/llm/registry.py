"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from lattica.llm import copy_queries, match_queries, name_queries, scan_queries, text_queries

_MODULES = (match_queries, scan_queries, name_queries, copy_queries, text_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
