"""Registered queries over the given tables, each with the SQL that states its result."""

from importlib import import_module

_MODULES = ("features", "preprocess", "rows", "monitoring", "analytics", "lake", "streaming", "models")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in _MODULES:
        module = import_module(f"tidemark.catalog.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
