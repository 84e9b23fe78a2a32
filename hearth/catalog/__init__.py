"""All named queries over the sample tables."""

from __future__ import annotations

from importlib import import_module

from .common import Query, with_prelude

MODULES = ["spending_queries", "stock_queries", "money_queries", "upkeep_queries", "stream_queries"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for query in import_module(f"{__name__}.{module}").QUERIES:
            if query.name in found:
                raise ValueError(f"two queries are called {query.name}")
            found[query.name] = query
    return found


def comparison_sql() -> dict[str, str]:
    return {name: with_prelude(q.sql) for name, q in all_queries().items() if q.sql}
