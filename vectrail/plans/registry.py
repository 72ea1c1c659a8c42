"""All registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

FLAGSHIP = "grounded_passages"
from vectrail.plans import mapping_queries, more_queries, record_queries, span_queries, stream_queries, table_queries, text_queries, vector_queries

MODULES: tuple = (vector_queries, text_queries, table_queries, span_queries, more_queries, record_queries, mapping_queries, stream_queries)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        for name, (query, _) in module.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = query
    return found


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
