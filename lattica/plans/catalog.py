"""All queries of the library with their SQL, by name: ``<operator of the inventory>_<what it shows>``."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def _load() -> None:
    from lattica.plans import analyses, dependence, graphs, pointers, programs, registration, strings, throwing, values  # noqa: F401


_load()
