"""The queries of the library and their SQL."""

from __future__ import annotations

from polyvec.plans import engine_queries, text_queries, vector_queries

_PARTS = (vector_queries, text_queries, engine_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
