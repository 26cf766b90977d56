"""The queries of this folder, and the SQL of those that SQL can express."""

from importlib import import_module

MODULES = ["packing", "jaccard", "pieces", "shards", "katz", "exact", "quality", "language", "warc", "repeats", "whitening", "toxicity", "prefixes"]


def _merged(part: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"tidemark.llm.{name}"), part))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
