"""Registered queries of the library."""

from tessera.plans import analysis_queries, corpus_queries, page_queries, registry_queries, review_queries

_MODULES = (review_queries, analysis_queries, corpus_queries, registry_queries, page_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
