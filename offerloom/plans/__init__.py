"""Plans: end-to-end jobs and the queries that run operators over the shared tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("resolution", "snapshots", "serieses", "texts", "sheets", "scores", "streams", "records")


def load_queries() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL
