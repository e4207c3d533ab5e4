"""The registered queries and their SQL, by name."""

from __future__ import annotations

from graupel.sources.fixtures import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of (spark, sf_dir) and SQL for the same rows; ``views`` are put before it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register
