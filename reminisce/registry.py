"""Name -> query and name -> oracle SQL of the conversation engine."""

from __future__ import annotations

from reminisce.plans import deep_queries, evidence_queries, extra_queries, more_queries, search_queries, state_queries, store_queries

_FAMILIES = (store_queries, search_queries, more_queries, extra_queries, deep_queries, state_queries, evidence_queries)


def queries() -> dict:
    return {k: f for m in _FAMILIES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _FAMILIES for k, s in m.oracle_sql().items()}
