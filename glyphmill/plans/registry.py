"""All core queries and their SQL."""

from __future__ import annotations

from . import core_queries, golden_queries, skew_queries

MODULES = (core_queries, golden_queries, skew_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
