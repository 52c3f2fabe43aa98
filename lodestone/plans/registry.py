"""Registered queries of the engine, by name, with their SQL counterparts."""

from __future__ import annotations

from lodestone.plans import catalog, data_queries, graph_queries, more_queries  # noqa: F401  (they register themselves)


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.SQL)
