"""Queries over the star-schema tables, each with the SQL that gives the same rows."""

from importlib import import_module

MODULES = (
    "fact_queries",
    "dim_queries",
    "view_queries",
    "cpu_queries",
    "plan_queries",
    "json_queries",
    "bundle_queries",
    "source_queries",
)


def load_all() -> None:
    """Register every query."""
    for name in MODULES:
        import_module(f"quarrylens.queries.{name}")
