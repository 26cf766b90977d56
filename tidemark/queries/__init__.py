"""Queries that bind every operator to the driver's tables, each with its SQL counterpart."""

from importlib import import_module

MODULES = [
    "sources", "results", "status", "keyed", "entities",
    "metrics", "normalize", "relational", "streams",
]


def _merged(part: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"tidemark.queries.{name}"), part))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
